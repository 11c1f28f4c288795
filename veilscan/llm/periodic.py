"""Periodic stretches of words (runs), found on a grammar of each text.

A run is a stretch with smallest period q (words q apart are equal) that no
neighbour extends, of at least ``LEAST`` words and ``TIMES`` periods.

1. A run of L words holds every one of its words in a ``GRAM``-word window that
   stands in it twice, q apart (L - q is at least ``GRAM``). Stretches covered by
   windows that their document repeats therefore hold all runs whole; the rest
   of the text is put aside. Equal windows have equal hashes, so none is lost.
2. Re-Pair turns the word ids of each stretch into a grammar: a most frequent
   pair of neighbours becomes a new symbol until no pair stands twice. Pairs of
   one stretch that are equally frequent and cannot overlap (left symbols and
   right symbols are disjoint sets) are replaced together, which is a sequence
   of single Re-Pair steps; all stretches of a slice take a round together. What
   is left, the start rule, is closed by a balanced tree.
3. A run lies inside the lowest symbol that holds it whole and crosses the
   boundary between that symbol's two halves. So each symbol's boundary is
   searched once, whatever the number of its places, and its runs are moved to
   every place where the symbol is derived.
4. Places of one run found in part are parts of it with its period; intervals
   of one period that share a period's length are merged to maximal ones.

All row by row: no shuffle, and memory follows the longest single text.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import _PLACE, CASED, NOT_BLANK, mix, text_slices, word_bounds, word_hashes

#: Words and periods that a run has at least (three periods or more).
LEAST, TIMES = 24, 3
#: Words that a run repeats after one period at least.
GRAM = LEAST - LEAST // TIMES
#: Words next to a boundary that recur one period away: the longer side of a run holds half of it.
SEED = LEAST // 2 - LEAST // TIMES

_PAIR = np.int64(1) << 31


def repeated_stretches(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the stretches covered by GRAM-word windows that their document repeats."""
    none = np.zeros(0, np.int64)
    if len(words) < GRAM:
        return none, none, none
    size = len(words) - GRAM + 1
    rolled = np.zeros(size, np.uint64)
    for j in range(GRAM):
        rolled += words[j:size + j] * _PLACE[j]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[:size] == owner[GRAM - 1:])
    doc = owner[at]
    key = mix(rolled[at] + doc.astype(np.uint64) * _PLACE[20])
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at, doc = at[twice], doc[twice]
    if not len(at):
        return none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] > at[:-1] + GRAM) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] + GRAM, doc[first]


def _pairs(symbols: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Places of the pairs that count: inside one stretch, and every other one of a symbol that follows itself."""
    ok = stretch[1:] == stretch[:-1]
    equal = ok & (symbols[1:] == symbols[:-1])
    if equal.any():
        place = np.arange(len(equal))
        begin = np.maximum.accumulate(np.where(equal & ~np.concatenate(([False], equal[:-1])), place, 0))
        ok &= ~equal | ((place - begin) % 2 == 0)
    return np.flatnonzero(ok)


def re_pair(symbols: np.ndarray, stretch: np.ndarray, n_terminals: int):
    """Re-Pair grammars of many stretches at once; no symbol may stand in two of them.

    Returns the start rules (symbols, stretch, in order) and the rules: the
    left and right symbol of ``n_terminals``, ``n_terminals`` + 1, ...
    """
    n_stretches = int(stretch[-1]) + 1 if len(stretch) else 0
    lefts, rights, done, next_symbol, turn = [], [], [], n_terminals, 0
    while len(symbols):
        at = _pairs(symbols, stretch)
        key = symbols[at] * _PAIR + symbols[at + 1]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        head = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), ordered[1:] != ordered[:-1])))
        count = np.diff(np.append(head, len(key)))
        pair, of = ordered[head], stretch[at[order[head]]]
        most = np.ones(n_stretches, np.int64)
        np.maximum.at(most, of, count)
        open_ = most[stretch] > 1
        if not open_.all():
            done.append((symbols[~open_], stretch[~open_]))
        if not open_.any():
            break
        turn += 1
        left, right = pair // _PAIR, pair % _PAIR
        top = (count == most[of]) & (count > 1)
        side = [(mix((x + turn * _PAIR).astype(np.uint64)) >> np.uint64(17) & np.uint64(1)) == s for x, s in ((left, 0), (right, 1))]
        chosen = top & side[0] & side[1] & (left != right)
        served = np.zeros(n_stretches, bool)
        served[of[chosen]] = True
        alone = np.flatnonzero(top & ~served[of])
        if len(alone):
            chosen[alone[np.unique(of[alone], return_index=True)[1]]] = True
        named = np.flatnonzero(chosen)
        lefts.append(left[named])
        rights.append(right[named])
        name = np.full(len(pair), -1, np.int64)
        name[named] = next_symbol + np.arange(len(named))
        next_symbol += len(named)
        new = np.repeat(name, count)
        place = at[order[new >= 0]]
        symbols = symbols.copy()
        symbols[place] = new[new >= 0]
        keep = open_
        keep[place + 1] = False
        symbols, stretch = symbols[keep], stretch[keep]
    out, of = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in (list(zip(*done)) or [(), ()]))
    order = np.argsort(of, kind="stable")
    empty = [np.zeros(0, np.int64)]
    return out[order], of[order], np.concatenate(lefts or empty), np.concatenate(rights or empty)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, lo, step = min(len(a), len(b)), 0, 64
    while lo < n:
        hi = min(n, lo + step)
        differ = a[lo:hi] != b[lo:hi]
        k = int(differ.argmax())
        if differ[k]:
            return lo + k
        lo, step = hi, step * 4
    return n


def _recurs(w: np.ndarray, most: int) -> np.ndarray:
    """Distances up to ``most`` at which the first SEED words of ``w`` recur."""
    n = min(len(w) - SEED, most)
    if n < 1:
        return np.zeros(0, np.int64)
    ok = w[1:n + 1] == w[0]
    for j in range(1, SEED):
        ok &= w[1 + j:n + 1 + j] == w[j]
    return np.flatnonzero(ok) + 1


def crossing_runs(w: np.ndarray, b: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the runs of ``w`` that hold words on both sides of ``b``."""
    n, back, ahead = len(w), w[:b][::-1], w[b:]
    found: list[tuple[int, int, int]] = []
    tries = [(int(q), 0) for q in _recurs(ahead, n // TIMES)] + [(int(q), 1) for q in _recurs(back, n // TIMES)]
    for q, to_left in sorted(tries):
        # a longer period inside that much of a shorter one is a multiple of it
        if any((b - s if to_left else e - b) >= q + p for p, s, e in found):
            continue
        if to_left:
            start, end = b - q - _common(back, back[q:]), b + _common(w[b - q:], ahead)
        else:
            start, end = b - _common(back, w[:b + q][::-1]), b + q + _common(ahead, ahead[q:])
        if start < b < end and end - start >= max(LEAST, TIMES * q) and (q, start, end) not in found:
            if not any(q % p == 0 and p < q and s <= start and e >= end for p, s, e in found):
                found.append((q, start, end))
    return found


def _start_rule_nodes(offsets: np.ndarray):
    """(start, boundary, end) of the inner nodes of a balanced tree over the symbols between ``offsets``."""
    todo = [(0, len(offsets) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1 and offsets[hi] - offsets[lo] >= LEAST:
            mid = (lo + hi) // 2
            yield int(offsets[lo]), int(offsets[mid]), int(offsets[hi])
            todo += [(lo, mid), (mid, hi)]


def find_runs(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``words`` are ids (64-bit hashes) of the words of all documents, ``bounds``
    delimits each document's.
    """
    starts, ends, docs = repeated_stretches(words, bounds)
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    n = ends - starts
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    stretch = np.repeat(np.arange(len(n)), n)
    names, text = np.unique(mix(words[at] + stretch.astype(np.uint64) * _PLACE[21]), return_inverse=True)
    text = text.astype(np.int64)
    rule, rule_of, left, right = re_pair(text, stretch, len(names))
    size = np.ones(len(names) + len(left), np.int64)
    for i in range(len(left)):
        size[len(names) + i] = size[left[i]] + size[right[i]]
    offset = np.cumsum(size[rule]) - size[rule]
    found = []  # (stretch, period, start, end) arrays
    edge = np.flatnonzero(np.concatenate(([True], rule_of[1:] != rule_of[:-1])))
    for lo, hi in zip(edge, np.append(edge[1:], len(rule))):
        ranges = np.append(offset[lo:hi], offset[hi - 1] + size[rule[hi - 1]])
        for s, b, e in _start_rule_nodes(ranges):
            for q, x, y in crossing_runs(text[s:e], b - s):
                found.append(np.array([[rule_of[lo], q, s + x, s + y]], np.int64))
    # all places of every symbol that is long enough, from the start rules down
    symbols, places, of = [], [], []
    now = (rule, offset, rule_of)
    while len(now[0]):
        long = (now[0] >= len(names)) & (size[now[0]] >= LEAST)
        sym, off, own = (x[long] for x in now)
        symbols.append(sym), places.append(off), of.append(own)
        a, b = left[sym - len(names)], right[sym - len(names)]
        now = tuple(np.concatenate(x) for x in ((a, b), (off, off + size[a]), (own, own)))
    symbols, places, of = (np.concatenate(x) for x in (symbols, places, of))
    order = np.argsort(symbols, kind="stable")
    symbols, places, of = symbols[order], places[order], of[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(len(symbols), 1), bool), symbols[1:] != symbols[:-1])))
    for lo, hi in zip(edge, np.append(edge[1:], len(symbols))):
        sym, first = symbols[lo], places[lo]
        for q, x, y in crossing_runs(text[first:first + size[sym]], int(size[left[sym - len(names)]])):
            k = hi - lo
            found.append(np.stack((of[lo:hi], np.full(k, q), places[lo:hi] + x, places[lo:hi] + y), axis=1))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    own, period, start, end = rows.T
    # merge intervals of one stretch and period that share a period's length
    group = np.cumsum(np.concatenate(([0], (own[1:] != own[:-1]) | (period[1:] != period[:-1]))))
    lift = group * (len(text) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(rows), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] + lift[1:] + period[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rows)) - 1
    own, period, start = own[first], period[first], start[first]
    end = reach[last] - lift[first]
    base = np.cumsum(n) - n
    doc = docs[own]
    start = start - base[own] + starts[own]
    end = end - base[own] + starts[own]
    out = np.stack((doc, start - bounds[doc], end - start, period), axis=1)
    return out[np.lexsort((period, start, doc))]


RUN = "struct<start:long,length:long,period:long>"


def _runs(batches):
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for rows, data, offsets in text_slices(batches):
        starts, ends = word_bounds(data, offsets, NOT_BLANK)
        bounds = np.searchsorted(starts, offsets)
        runs = find_runs(word_hashes(data, starts, ends, CASED), bounds)
        lo = np.searchsorted(runs[:, 0], np.arange(rows.num_rows + 1))
        best, texts = [], []
        for i in range(rows.num_rows):
            own = runs[lo[i]:lo[i + 1], 1:].tolist()
            parts = data[offsets[i]:offsets[i + 1]].tobytes().split()
            if own:
                start, length, period = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                best.append({"start": start, "length": length, "period": period})
                drop = np.zeros(len(parts) + 1, np.int64)
                for s, n, q in own:
                    drop[s + q] += 1
                    drop[s + n] -= 1
                parts = [p for p, d in zip(parts, np.cumsum(drop).tolist()) if not d]
            else:
                best.append(None)
            texts.append(b" ".join(parts))
        values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(kind))
        yield pa.RecordBatch.from_pydict({
            **{c: rows.column(c) for c in rows.schema.names if c != "text"},
            "n_words": pa.array(np.diff(bounds)), "best": pa.array(best, kind),
            "runs": pa.ListArray.from_arrays(pa.array(lo.astype(np.int32)), values),
            "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, best, runs and collapsed.

    ``runs`` lists every run (start, length, period, in words from 0) by start
    and period; ``best`` is the one with the greatest length / period (ties:
    smallest start, then period), null without runs; ``collapsed`` has the words
    that are in no run after its first period, joined by one blank. Words are
    what stands between ASCII blanks; inside a document they are told apart by
    64 hash bits. Null, empty and blank texts have no words and no runs. Every
    row is judged by itself: repeated ids and rows and null ids are all returned.
    An empty table gives no rows; other columns are not read. A text is one
    task's work, whatever its length.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(_runs, f"doc_id {kind}, n_words long, best {RUN}, runs array<{RUN}>, collapsed string"))


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text, and for a tenth of the documents one whose words repeat from a word on.

    With h the CRC-32 of the decimal id and g = floor(h / 10): where h % 10 is 0,
    word i >= a becomes word a + (i - a) % p, for a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeat(ws):
        n = F.size(ws).cast("long")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # bound once: a lambda's free expressions would be computed for every word
    bound = F.transform(F.array(F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1)),
                        lambda ws: F.when(F.size(ws) > 0, repeat(ws)).otherwise(text))
    return F.when((h % 10 == 0) & text.isNotNull(), F.get(bound, 0)).otherwise(text)
