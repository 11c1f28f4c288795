"""License scan: short notices found exactly and with a bounded number of edits.

A notice allowed k edits is cut into k + 1 pieces; one of them must occur
unchanged (pigeonhole), so an Aho-Corasick pass over the exact pieces finds
every candidate. Around each the ``regex`` library's bounded-error matching
verifies the notice and gives its span and edits. Notices are compared with a
text's lower-cased words joined by single blanks, between blanks, so a match is
whole words. Row by row, without a shuffle.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import ALNUM, LOWER

#: The base phrases and labels of the contract.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: The method's own notices.
NOTICES = [
    ("all rights reserved", "reserved"), ("general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"), ("gnu affero general public license", "agpl"),
    ("creative commons attribution", "cc-by"), ("creative commons zero", "cc0"),
    ("licensed under the apache license", "apache"), ("apache license version 2 0", "apache"),
    ("permission is hereby granted free of charge", "mit"), ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms", "bsd"), ("mozilla public license", "mpl"),
    ("this work is dedicated to the public domain", "public-domain"),
]
#: One edit is allowed for this many characters of a notice.
CHARS_PER_EDIT = 9

_SPACED = np.where(ALNUM, LOWER, np.uint8(32)).astype(np.uint8).tobytes()


def edits_allowed(phrase: str) -> int:
    return len(phrase) // CHARS_PER_EDIT


def pieces(phrase: str, k: int) -> list[tuple[int, str]]:
    """``phrase`` cut into k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(phrase) / (k + 1)) for i in range(k + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Notices compiled: (phrase, label, edits, base) each, one automaton over all their pieces."""

    def __init__(self, base: list[tuple[str, str]], notices: list[tuple[str, str]]):
        self.notices = [(f" {p} ", label, 0, True) for p, label in base]
        self.notices += [(f" {p} ", label, edits_allowed(p), False) for p, label in notices]
        self.patterns, seeds = [], {}
        for i, (phrase, _, k, _) in enumerate(self.notices):
            core = regex.escape(phrase.strip(), literal_spaces=True)
            self.patterns.append(regex.compile(rf"(?<= )(?:{core}){{e<={k}}}(?= )", regex.BESTMATCH) if k else None)
            for at, piece in pieces(phrase.strip(), k) if k else [(0, phrase)]:
                seeds.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def spans(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) in the normal text; of overlapping spans of one notice the best stays."""
        windows: dict[int, set[tuple[int, int]]] = {}
        out = []
        for end, (size, uses) in self.automaton.iter(norm):
            for i, at in uses:
                phrase, _, k, _ = self.notices[i]
                start = end + 1 - size - at
                if k == 0:
                    out.append((i, start + 1, start + len(phrase) - 1, 0))
                else:
                    # a window holds one whole place at most, so each candidate is one search of bounded size
                    windows.setdefault(i, set()).add((max(0, start - k - 1), min(len(norm), start + len(phrase) - 2 + k + 1)))
        for i, mine in windows.items():
            found = {(m.start(), m.end(), sum(m.fuzzy_counts)) for m in (self.patterns[i].search(norm, a, b) for a, b in mine) if m and m.end() > m.start()}
            out += [(i, *span) for span in best_apart(found)]
        return sorted(set(out), key=lambda s: (s[1], s[2], s[0]))


def best_apart(spans: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, edits) that do not overlap, chosen by fewest edits, then start and end."""
    kept: list[tuple[int, int, int]] = []
    cluster: list[tuple[int, int, int]] = []
    reach = -1
    for span in [*sorted(spans), (1 << 62, 0, 0)]:
        if span[0] >= reach:
            own: list[tuple[int, int, int]] = []
            for s in sorted(cluster, key=lambda x: (x[2], x[0], x[1])):
                if all(s[1] <= t[0] or t[1] <= s[0] for t in own):
                    own.append(s)
            kept, cluster = kept + own, []
        cluster.append(span)
        reach = max(reach, span[1])
    return kept


@lru_cache(8)
def scanner(base: tuple, notices: tuple) -> Scanner:
    return Scanner(list(base), list(notices))


def _scan(base: tuple, notices: tuple):
    span = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int64()),
                      ("edits", pa.int64()), ("similarity", pa.float64()), ("found", pa.string())])

    def run(batches):
        s = scanner(base, notices)
        for batch in batches:
            n_words, spans = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().translate(_SPACED).split()
                n_words.append(len(words))
                norm = " " + b" ".join(words).decode() + " "
                mine, places = [], s.spans(norm) if words else []
                if places:
                    blanks = np.flatnonzero(np.frombuffer(norm.encode("utf-32-le"), np.uint32) == 32)
                for i, start, end, edits in places:
                    phrase, label, _, is_base = s.notices[i]
                    found = norm[start:end]
                    mine.append({"label": label, "base": is_base, "first_word": int(np.searchsorted(blanks, start)) - 1,
                                 "words": found.count(" ") + 1, "edits": edits,
                                 "similarity": max(0.0, 1 - edits / (len(phrase) - 2)), "found": found})
                spans.append(mine)
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in batch.schema.names if c != "text"},
                                              "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(span))})
    return run


SPANS = "array<struct<label:string,base:boolean,first_word:bigint,words:bigint,edits:bigint,similarity:double,found:string>>"


def scan(docs: DataFrame, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, spans (label, base, first_word, words, edits, similarity, found text).

    A null or wordless text has no words and no spans; the whole of a text of
    any length is searched; overlapping spans of different notices and repeated
    places of one notice are all given, of overlapping places of one notice the
    one with fewest edits. Every row is judged by itself: repeated rows and ids
    and null ids are all returned. An empty table gives no rows; other columns
    are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_scan(tuple(base), tuple(notices)), f"doc_id long, n_words long, spans {SPANS}")


def summary(found: DataFrame) -> DataFrame:
    """Digest of ``scan``: base places and all labels per document."""
    at_base = F.filter("spans", lambda s: s["base"])
    firsts = F.transform(at_base, lambda s: s["first_word"])

    def names(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(at_base).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), names(at_base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"))
