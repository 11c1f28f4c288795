"""Packing by shortest-pack-first over the length histogram.

Documents are tokenised once and written with their ids. Full sequences' worth
of ids is cut off the front of long documents; the histogram of lengths (at
most ``size`` bins) goes to the driver, which packs lengths longest first, a
whole bin and a whole range of like packs at a time, into the pack with the
most room. A new pack is opened only while what is left exceeds the room in
the packs there are; after that a length that fits nowhere is cut to fill a
pack and its tail goes back to the histogram. The plan is a table of rank
intervals: (length, ranks) -> (sequences, offset). Documents find their place
by the rank of their length: a local rank given while tokenising plus the
count of that length in earlier partitions, so no length is ranked in one task.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store
from .textbytes import CASED, LOWER, NOT_BLANK, text_slices, word_bounds, word_hashes

SIZE = 2048
END_ID = 1
#: Room below this many ids is left as padding rather than filled with a crumb.
CRUMB = 16
#: Different blank-separated chunks kept with their ids by each Python worker.
CACHE_CHUNKS = 1_500_000
#: Bytes of text that are tokenised at a time.
SLICE = 4 << 20
#: Bytes of base ranks that are broadcast at most.
BROADCAST = 64 << 20
_NEVER = 1 << 32

#: The word pattern of the vocabulary file's pre-tokenizer.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = re.compile("[!-~À-ɏ]+")
#: Multiplication and division signs, and the one letter that becomes two when lower-cased.
_NOT_LETTERS = np.array([0xD7, 0xF7, 0x130], np.uint32)
#: Letter 0 (multi-byte ones too), digit 1 (a piece of its own), other 2.
_KIND = np.array([0 if b >= 128 or 97 <= b <= 122 or 65 <= b <= 90 else 1 if 48 <= b <= 57 else 2 for b in range(256)], np.uint8)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of blank-separated chunks, equal to those of the vocabulary file's whole tokenizer.

    Chunks never share a token, so the ids of a text are those of its chunks,
    and equal chunks (64 hash bits) are tokenised once. Plain chunks (printable
    ASCII, Latin letters, which are in NFC by themselves, no special token) are cut by the pre-tokenizer's
    pattern, and the merges of all of them are done together, the first pair of
    lowest rank of every piece in each round; any other chunk goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, tail = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([ids.get(letters[b], -1) for b in range(256)], np.int64)
        self.last = np.array([ids.get(letters[b] + tail, -1) for b in range(256)], np.int64)
        pairs = [(a, b) if isinstance(a, str) else None for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pairs, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        # pairs of single bytes by table
        self.low = 1 + int(max(self.inner.max(), self.last.max()))
        self.first = np.full((self.low, self.low), _NEVER, np.int64)
        a, b = self.pairs >> 20, self.pairs & (1 << 20) - 1
        small = (a < self.low) & (b < self.low)
        self.first[a[small], b[small]] = self.rank[small]
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids among the merges, ``_NEVER`` where it is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], _NEVER)

    def merge(self, ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merges of the ids of rising pieces: the first pair of lowest rank, again and again."""
        done = []
        rank = np.append(np.where(piece[1:] == piece[:-1], self.first[ids[:-1], ids[1:]], _NEVER), _NEVER) if len(ids) else np.zeros(0, np.int64)
        while len(ids):
            head = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            n = np.diff(np.append(head, len(ids)))
            best = np.minimum.reduceat(rank * len(ids) + np.arange(len(ids)), head)
            open_ = best < _NEVER * len(ids)
            stays = np.repeat(open_, n)
            if not open_.all():
                done.append((ids[~stays], piece[~stays]))
            at = best[open_] % len(ids)
            ids[at] = self.merged[best[open_] // len(ids)]
            # the pair's second id goes; the rank of the pair before and of the new one changes
            rank[at] = _NEVER
            follows = at + 2 < len(ids)
            follows[follows] = piece[at[follows] + 2] == piece[at[follows]]
            rank[at[follows]] = self.ranks(ids[at[follows]], ids[at[follows] + 2])
            ahead = at > 0
            ahead[ahead] = piece[at[ahead] - 1] == piece[at[ahead]]
            rank[at[ahead] - 1] = self.ranks(ids[at[ahead] - 1], ids[at[ahead]])
            stays[at + 1] = False
            ids, piece, rank = ids[stays], piece[stays], rank[stays]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, piece = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(piece, kind="stable")
        return ids[order], piece[order]

    def _tokenise(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has."""
        n = ends - starts
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text, owner = data[at], np.repeat(np.arange(len(n)), n)
        high, ticks = np.zeros(len(n), bool), np.zeros(len(n), bool)
        high[owner[text >= 128]] = True
        # contractions, special tokens and control characters are left to the regex and the whole tokenizer
        ticks[owner[(text == 39) | (text == 127) | (text < 33)]] = True
        bars = np.flatnonzero((text[:-1] == 60) & (text[1:] == 124))
        ticks[owner[bars]] = True
        keep = ~(high | ticks)[owner]
        parts, owners = [LOWER[text[keep]]], [owner[keep]]
        high &= ~ticks
        if high.any():
            # Latin letters: lower-cased together, told apart by line feeds
            own = np.flatnonzero(high)
            joined = b"\n".join(data[starts[i]:ends[i]].tobytes() for i in own).decode()
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            line = np.cumsum(points == 10)
            odd = ((points > 126) & (points < 0xC0)) | (points > 0x24F) | np.isin(points, _NOT_LETTERS)
            other = np.zeros(len(own), bool)
            other[line[odd]] = True
            ticks[own[other]] = True
            if not other.all():
                lowered = "\n".join(x for x, o in zip(joined.split("\n"), other.tolist()) if not o).lower().encode()
                text = np.frombuffer(lowered, np.uint8)
                line = np.cumsum(text == 10)
                parts.append(text[text != 10])
                owners.append(own[~other][line[text != 10]])
        text, owner = np.concatenate(parts), np.concatenate(owners)
        kind = _KIND[text]
        new = np.ones(len(text), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        pieces, whole, whole_of = [], [], []
        for i in np.flatnonzero(ticks).tolist():
            word = data[starts[i]:ends[i]].tobytes().decode()
            if _PLAIN.fullmatch(word) and "<|" not in word and "\u0130" not in word:
                pieces += [(i, p.encode()) for p in PIECES.findall(word.lower())]
            else:
                whole.append(word)
                whole_of.append(i)
        if pieces:
            size = np.array([len(p) for _, p in pieces])
            first = np.zeros(size.sum(), bool)
            first[np.cumsum(size) - size] = True
            text = np.concatenate((text, np.frombuffer(b"".join(p for _, p in pieces), np.uint8)))
            owner = np.concatenate((owner, np.repeat([i for i, _ in pieces], size)))
            new = np.concatenate((new, first))
        end = np.append(new[1:], True)[:len(new)]
        ids, piece = self.merge(np.where(end, self.last[text], self.inner[text]), np.cumsum(new) - 1)
        owner = owner[new][piece]
        if whole:
            found = [e.ids for e in self.full.encode_batch(whole, add_special_tokens=False)]
            ids = np.concatenate((ids, np.array([x for f in found for x in f], np.int64)))
            owner = np.concatenate((owner, np.repeat(whole_of, [len(f) for f in found])))
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(owner, minlength=len(n))

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks of a slice, and how many each has."""
        names, first, which = np.unique(word_hashes(data, starts, ends, CASED), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_CHUNKS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, names), max(len(self.known) - 1, 0))
        new = self.known[at] != names if len(self.known) else np.ones(len(names), bool)
        if new.any():
            ids, count = self._tokenise(data, starts[first[new]], ends[first[new]])
            place = len(self.pool) + np.cumsum(count) - count
            self.pool = np.concatenate((self.pool, ids))
            known = np.concatenate((self.known, names[new]))
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.at, self.count = (np.concatenate(x)[order] for x in ((self.at, place), (self.count, count)))
            at = np.searchsorted(self.known, names)
        n = self.count[at][which]
        take = np.repeat(self.at[at][which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.pool[take], n


_caches: dict[str, Vocabulary] = {}

TOKENS = "doc_id long, part long, n_tokens long, full_rank long, rest long, rest_rank long, ids binary"


def _tokenise(path: str, size: int):
    def run(batches):
        vocabulary = _caches.setdefault(path, Vocabulary(path) if path not in _caches else None)
        part = TaskContext.get().partitionId()
        seen = np.zeros(size, np.int64)
        full = 0
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            starts, ends = word_bounds(data, offsets, NOT_BLANK)
            ids, count = vocabulary.ids(data, starts, ends)
            before = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, offsets)]
            n = np.diff(before) + 1
            ids = np.insert(ids, before[1:], END_ID).astype("<u4")
            rest = n % size
            full_rank = full + np.cumsum(n // size) - n // size
            full += int((n // size).sum())
            rank = np.empty(len(n), np.int64)
            for i, r in enumerate(rest):
                rank[i] = seen[r]
                seen[r] += 1
            cuts = np.concatenate(([0], np.cumsum(4 * n))).astype(np.int32 if 4 * n.sum() < 1 << 31 else np.int64)
            kind = pa.binary() if cuts.dtype == np.int32 else pa.large_binary()
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "part": pa.array(np.full(len(n), part, np.int64)), "n_tokens": pa.array(n),
                "full_rank": pa.array(full_rank), "rest": pa.array(rest), "rest_rank": pa.array(rank),
                "ids": pa.Array.from_buffers(kind, len(n), [None, pa.py_buffer(cuts), pa.py_buffer(ids)]).cast(pa.binary())})
    return run


def plan(histogram: dict[int, int], size: int = SIZE, crumb: int = CRUMB) -> dict[int, list[tuple]]:
    """Per length the rank intervals (lo, hi, sequence of lo, offset, piece length, tail's rank of lo), by lo.

    Packs are ranges of sequence numbers with the same fill. A piece shorter
    than its length is a cut; its tail has the length left and the given rank.
    """
    left = defaultdict(int, {k: v for k, v in histogram.items() if v})
    ranks: dict[int, int] = defaultdict(int, left)  # next rank for tails
    done: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple]] = defaultdict(list)
    packs: dict[int, list[list[int]]] = defaultdict(list)  # room -> ranges [first, count]
    rooms: list[int] = []  # sorted rooms that have ranges
    volume, room_total, next_sequence = sum(k * v for k, v in left.items()), 0, 0

    def keep(room: int, first: int, count: int):
        nonlocal room_total
        if count and room >= crumb:
            if not packs[room]:
                bisect.insort(rooms, room)
            packs[room].append([first, count])
            room_total += room * count

    def take(room: int, most: int) -> tuple[int, int]:
        nonlocal room_total
        first, count = packs[room].pop()
        if not packs[room]:
            rooms.remove(room)
        room_total -= room * count
        used = min(most, count)
        keep(room, first + used, count - used)
        return first, used

    for length in range(size, 0, -1):
        while left[length]:
            lo, most = done[length], left[length]
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                first, used = take(room, most)
                out[length].append((lo, lo + used, first, size - room, length, -1))
                keep(room - length, first, used)
            elif rooms and volume <= room_total:
                room = rooms[-1]
                first, used = take(room, most)
                tail = length - room
                out[length].append((lo, lo + used, first, size - room, room, ranks[tail]))
                ranks[tail] += used
                left[tail] += used
                volume += tail * used
            else:
                used = min(most, max(1, -(-(volume - room_total) // size)))
                first, next_sequence = next_sequence, next_sequence + used
                out[length].append((lo, lo + used, first, 0, length, -1))
                keep(size - length, first, used)
            done[length] += used
            left[length] -= used
            volume -= length * used
    return dict(out)


def _place(steps: dict[int, list[tuple]], size: int):
    starts = {length: [s[0] for s in rows] for length, rows in steps.items()}

    def pieces(length: int, rank: int):
        while length:
            lo, _, first, offset, piece, tail = steps[length][bisect.bisect_right(starts[length], rank) - 1]
            yield first + rank - lo, offset, piece
            length, rank = length - piece, tail + rank - lo

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "full_rank", "rest", "rest_rank", "ids")]
            for doc_id, n, full_rank, rest, rest_rank, ids in zip(*cols):
                at = 0
                where = [p for k in range(n // size) for p in pieces(size, full_rank + k)] + list(pieces(rest, rest_rank))
                for sequence, offset, length in where:
                    row = (doc_id, at, length, zlib.crc32(ids[4 * at:4 * (at + length)]), n, sequence, offset)
                    for column, value in zip(out, row):
                        column.append(value)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=PIECE_NAMES)
    return run


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text by the vocabulary file (default: the
    public ``word_bpe_49k.json``), then ``END_ID``; a null or empty text has
    that id alone. Each row of ``docs`` is packed, rows that repeat an id and
    rows with a null id too. An empty table gives no rows; columns other than
    doc_id and text are not read. Documents of equal length are ranked by their place
    in the input. A text is one task's work, whatever its length. Base ranks (a list
    of ``size`` numbers per partition) are broadcast up to ``BROADCAST`` bytes,
    beyond it joined.
    """
    if vocabulary is None:
        import public_tokenizers
        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    store = Store(docs.sparkSession, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = store.save(texts.mapInArrow(_tokenise(str(vocabulary), size), TOKENS), "tokens")
    # whole sequences' worth of ids count as pieces of the full length
    pieces = tokens.select("part", F.explode(F.array(
        F.struct(F.col("rest").alias("length"), F.lit(1).cast("long").alias("n")),
        F.struct(F.lit(size).cast("long").alias("length"), F.floor(F.col("n_tokens") / size).alias("n")))).alias("p"))
    local = store.save(pieces.groupBy("part", "p.length").agg(F.sum("p.n").alias("n")).filter("length > 0 AND n > 0"), "counts")
    histogram = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = local.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    listed = before.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("m"))
    base = store.save(listed.select("part", F.transform(F.sequence(F.lit(0), F.lit(size)), lambda i: F.coalesce(
        F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))).alias("base")), "base")
    if base.count() * (size + 1) * 8 <= BROADCAST:
        base = F.broadcast(base)
    ranked = tokens.join(base, "part").select(
        "doc_id", "n_tokens", (F.col("full_rank") + F.get("base", F.lit(size))).alias("full_rank"), "rest",
        (F.col("rest_rank") + F.get("base", F.col("rest").cast("int"))).alias("rest_rank"), "ids")
    return ranked.mapInArrow(_place(plan(histogram, size), size), ", ".join(f"{c} long" for c in PIECE_NAMES))
