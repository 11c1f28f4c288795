"""Removal of repeated 200-byte strings, anywhere in the corpus, by external induced suffix sorting.

1. Shards. Equal 200-byte strings have the same least gram hash, so the starts
   of a text are cut into regions: runs of starts with one least hash. Two
   starts can only match under the same hash. A hash in one region only, whose gram
   stands there once, is done; equal regions are counted and
   enter once, those that occur twice are repeated as a whole.
2. Sorting. What is left, the different regions under one hash, is dealt to
   shards by that hash. A shard is written to a file and its suffixes are put
   in order by external induced sorting (`induced_sort`), whose tuples carry
   common-prefix values: a start is repeated where it shares 200 bytes with a
   neighbour in the order.
3. Removal. Repeated starts come back as intervals per document; their bytes
   are cut out.

A hash with very many different regions (a passage in ever other company) is
split: its regions are cut where the offset to the gram of that hash crosses a
multiple of ``BLOCK``, and dealt by the bytes that all starts of a piece share.
Equal pieces repeat each other whole and are sorted once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .induced_sort import BATCH, BUFFER, Scratch, suffixes_with_prefixes
from .store import Store
from .textbytes import CHUNK, mix, text_buffer

MATCH = 200
GRAM = 40
#: Starts of GRAM-byte strings inside one MATCH-byte string.
SPAN = MATCH - GRAM + 1
#: Bytes of regions that a task's partition holds on average, and of the shards in it that are sorted together.
SHARD_BYTES, SORT_BYTES = 4 << 20, 1 << 20
#: A hash with more different regions is split into pieces of up to BLOCK starts.
SPLIT, BLOCK = 512, 32
#: Starts of a long text that are cut into regions at a time. Where a cut falls
#: does not matter: regions of one hash are compared wherever they lie.
STARTS = 1 << 22

_rng = np.random.default_rng(77)
_EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def _sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * _power(len(data))[0][:len(data)], out=out[1:])
    return out


def _sliding(values: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of SPAN values."""
    n, width = len(values) - SPAN + 1, 1
    while width * 2 <= SPAN:
        values = pick(values[:-width], values[width:])
        width *= 2
    return pick(values[:n], values[SPAN - width:SPAN - width + n])


def regions(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of starts of MATCH-byte strings with one least gram hash: first, count, key, digest of the bytes, inner.

    ``inner``: the gram of the hash stands twice within reach, so the region may
    repeat strings inside itself.
    """
    n = len(data) - MATCH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool)
    sums = _sums(data, _EXACT)
    inverse = _power(len(data))[1]
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(data) - GRAM + 1])
    low = _sliding(grams, np.minimum)
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    count = np.diff(np.concatenate((first, [n])))
    pad = np.zeros(SPAN - 1, np.uint64)
    least = np.flatnonzero(_sliding(np.concatenate((pad, low, pad)), np.maximum) == grams)
    again = (grams[least[1:]] == grams[least[:-1]]) & (np.diff(least) <= SPAN)
    inner = np.isin(low[first], grams[least[1:][again]]) if again.any() else np.zeros(len(first), bool)
    other = _sums(data, _OTHER)
    digest = mix((other[first + count + MATCH - 1] - other[first]) * inverse[first] + count.astype(np.uint64))
    return first, count, low[first], digest, inner


def _region_rows(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
        out, held = [], 0
        for i, doc_id in enumerate(ids):
            for at in range(int(offsets[i]), int(offsets[i + 1]), STARTS):
                first, count, key, digest, inner = regions(data[at:min(at + STARTS + MATCH - 1, offsets[i + 1])])
                if len(first):
                    out.append((np.full(len(first), doc_id, np.int64), np.full(len(first), texts[i], np.int64), first + (at - offsets[i]), count,
                                key.view(np.int64), digest.view(np.int64), inner))
                    held += len(first)
            if held > 1 << 15 or (out and i == len(ids) - 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["doc_id", "th", "first", "n", "key", "digest", "inner"])
                out, held = [], 0


def _core_pieces(body: np.ndarray, n: int, key: int) -> list[tuple[int, int, int]]:
    """(shard key, first start, starts) of the pieces of one region: by block of offsets to its gram, and shared bytes."""
    sums = _sums(body, _EXACT)
    inverse = _power(len(body))[1]
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:len(body) - GRAM + 1])
    at = np.flatnonzero(grams == np.uint64(key & (2**64 - 1)))
    starts = np.arange(n)
    anchor = at[np.searchsorted(at, starts)]
    block = (anchor - starts) // BLOCK
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]), [True])))
    a, b = anchor[cut[:-1]], block[cut[:-1]]
    lo, hi = a - b * BLOCK, a - np.minimum((b + 1) * BLOCK - 1, SPAN - 1) + MATCH
    core = mix(((sums[hi] - sums[lo]) * inverse[lo]) ^ np.uint64(key & (2**64 - 1)) ^ mix(b.astype(np.uint64) + np.uint64(1)))
    return list(zip(core.view(np.int64).tolist(), cut[:-1].tolist(), np.diff(cut).tolist()))


PIECE = "shard long, key long, digest long, first long, n long, bytes binary, again boolean"


def _pieces(batches):
    """Pieces of the wanted regions; of equal ones of split regions in a batch one has the bytes, all are marked ``again``.

    A text of few repeated words is one region with the gram every few bytes: its
    pieces have many times its bytes, and nearly all are equal. Neighbours
    without bytes are one row.
    """
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        out, seen = [], {}
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            text = data[offsets[i]:offsets[i + 1]]
            for w in wanted:
                body = text[w["first"]:w["first"] + w["n"] + MATCH - 1]
                if not w["split"]:
                    out.append([w["key"], w["key"], w["digest"], 0, w["n"], body.tobytes(), False])
                    continue
                joins = False  # the row before is of this region and without bytes
                for shard, first, n in _core_pieces(body, w["n"], w["key"]):
                    piece = body[first:first + n + MATCH - 1].tobytes()
                    same = seen.setdefault(piece, len(out))
                    if same == len(out):
                        out.append([shard, w["key"], w["digest"], first, n, piece, False])
                        joins = False
                        continue
                    out[same][6] = True
                    if joins and out[-1][3] + out[-1][4] == first:
                        out[-1][4] += n
                    else:
                        out.append([shard, w["key"], w["digest"], first, n, None, True])
                    joins = True
        cols = list(zip(*out)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.bool_())],
                                         names=["shard", "key", "digest", "first", "n", "bytes", "again"])


def shared_prefix(data: np.ndarray, rest: np.ndarray, cap: int):
    """Capped common prefix of suffixes of ``data``; ``rest`` is how far each place is from its separator."""
    words = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.minimum(np.minimum(rest[a], rest[b]), cap).astype(np.int64)
        got = most.copy()
        live, k = np.flatnonzero(most > 0), 0
        while len(live):
            differ = words[a[live] + k] ^ words[b[live] + k]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8)
            stop = same < 8
            got[live[stop]] = np.minimum(got[live[stop]], k + same[stop])
            k += 8
            live = live[~stop]
            live = live[most[live] > k]
        return got.astype(np.uint8)
    return compare


def repeated_starts(bodies: list[bytes] | list[np.ndarray], counts: np.ndarray, buffer: int = BUFFER, batch: int = BATCH) -> list[np.ndarray]:
    """Per body the starts (below its count) whose MATCH bytes start at another valid start of the shard too."""
    n_sep = len(bodies)
    sizes = np.array([len(b) for b in bodies], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    total = int(begin[-1])
    scratch = Scratch()
    try:
        data, x = scratch.array(total + 8, np.uint8), scratch.array(total, np.int32)
        rest = scratch.array(total, np.uint8)
        separators = np.append(np.random.default_rng(n_sep).permutation(n_sep - 1) + 1, 0)
        for j, body in enumerate(bodies):
            a, b = int(begin[j]), int(begin[j + 1]) - 1
            data[a:b] = np.frombuffer(body, np.uint8)
            x[a:b] = data[a:b].astype(np.int32) + n_sep
            x[b] = separators[j]
            left = np.arange(b - a, 0, -1)
            rest[a:b] = np.minimum(left, 255)
        order, shared = suffixes_with_prefixes(x, MATCH, shared_prefix(data, rest, MATCH), n_sep, scratch, buffer, batch)
        twin = np.flatnonzero(shared >= MATCH)
        marked = np.unique(np.concatenate((order[twin], order[twin - 1])))
        owner = np.searchsorted(begin, marked, "right") - 1
        local = marked - begin[owner]
        ok = local < counts[owner]
        owner, local = owner[ok], local[ok]
        return np.split(local, np.searchsorted(owner, np.arange(1, n_sep)))
    finally:
        scratch.close()


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate(([True], starts[1:] != starts[:-1] + 1))) if len(starts) else np.zeros(0, np.int64)
    return starts[cut], np.diff(np.concatenate((cut, [len(starts)])))


def _sort_shard(batches):
    """Sorts the different pieces of a task's partition, which must fit in memory, some shards at a time; equal ones repeat each other."""
    meta, of, place = [], [], {}
    for batch in batches:
        meta.append(np.stack([np.asarray(batch.column(c)) for c in ("key", "digest", "first", "n", "shard", "again")], axis=1))
        of += [place.setdefault(body, len(place)) for body in batch.column("bytes").to_pylist()]
    if not place:
        return
    meta, of, bodies = np.concatenate(meta), np.array(of), list(place)
    whole = (np.bincount(of) > 1) | (np.bincount(of, meta[:, 5]) > 0)
    if whole.any():
        yield _marks(meta[whole[of]], *meta[whole[of]][:, 2:4].T)
    row_of = np.empty(len(bodies), np.int64)
    row_of[of] = np.arange(len(of))
    order = np.argsort(meta[row_of, 4], kind="stable")
    meta, bodies, whole = meta[row_of[order]], [bodies[i] for i in order], whole[order]
    size = np.concatenate(([0], np.cumsum([len(b) for b in bodies])))
    lo = 0
    for hi in [*(np.flatnonzero(np.diff(meta[:, 4])) + 1).tolist(), len(bodies)]:
        if size[hi] - size[lo] < SORT_BYTES and hi < len(bodies):
            continue
        # each 200 bytes of a piece that stands elsewhere are known to repeat; the others may share some with it
        for j, starts in enumerate([] if whole[lo:hi].all() else repeated_starts(bodies[lo:hi], meta[lo:hi, 3]), lo):
            first, n = _runs(starts)
            if len(first) and not whole[j]:
                yield _marks(np.repeat(meta[j:j + 1], len(first), axis=0), first + meta[j, 2], n)
        lo = hi


def _marks(rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (rows[:, 0], rows[:, 1], first, n)], names=["key", "digest", "first", "n"])


def repeated_intervals(texts: DataFrame, store: Store) -> DataFrame:
    """(doc_id, th, first, n): runs of starts whose 200 bytes also start elsewhere; runs may overlap or touch.

    ``texts`` has doc_id, text and th, the text's hash: rows of one id are told apart by it.
    """
    rows = store.save(texts.mapInArrow(_region_rows, "doc_id long, th long, first long, n long, key long, digest long, inner boolean"), "regions")
    keys = rows.groupBy("key").agg(F.count("*").alias("k"), F.max("inner").alias("inner")).filter((F.col("k") > 1) | F.col("inner"))
    keys = store.save(keys.select("key"), "keys")
    # most regions stand alone: only those whose key may be repeated are shuffled
    repeated = Bitmap(store, keys, "key")
    shared = store.save(repeated.mark(rows, F.col("key"), "hit").filter("hit").drop("hit").join(keys, "key", "left_semi"), "shared")
    store.drop(rows, keys, repeated.pieces)
    equal = store.save(shared.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.max("inner").alias("inner"), F.min(F.struct("doc_id", "th", "first", "n")).alias("one")), "equal")
    whole = (shared.join(equal.filter("copies > 1").select("key", "digest"), ["key", "digest"], "left_semi").select("doc_id", "th", "first", "n"))
    mixed = (equal.groupBy("key").agg(F.count("*").alias("kinds"), F.max("inner").alias("inner"))
             .filter((F.col("kinds") > 1) | F.col("inner")).select("key", (F.col("kinds") > SPLIT).alias("split")))
    sent = store.save(equal.join(mixed, "key").select("key", "digest", "copies", "one.*", "split"), "sent")
    wanted = (sent.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("of"))
              .agg(F.collect_list(F.struct("key", "digest", "first", "n", "split")).alias("wanted")))
    holders = Bitmap(store, sent, "doc_id")
    held = holders.mark(texts, F.col("doc_id"), "hit").filter("hit")
    pieces = store.save(held.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("of")))
                        .select("text", "wanted").mapInArrow(_pieces, PIECE), "pieces")
    size = pieces.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    mark = "key long, digest long, first long, n long"
    sort = pieces.filter("bytes IS NOT NULL").repartition(shards, "shard").mapInArrow(_sort_shard, mark)
    marks = store.save(sort.unionAll(pieces.filter("bytes IS NULL").select("key", "digest", "first", "n")), "marks")
    store.drop(pieces, holders.pieces)
    found = (marks.join(sent.filter("copies = 1").select("key", "digest", "doc_id", "th", F.col("first").alias("at")), ["key", "digest"])
             .select("doc_id", "th", (F.col("at") + F.col("first")).alias("first"), "n"))
    intervals = store.save(whole.unionAll(found), "intervals")
    store.drop(shared, equal, sent, marks)
    return intervals


def _cut(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        out = [[], [], [], [], []]
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text = data[offsets[i]:offsets[i + 1]]
            keep, n_spans = np.ones(len(text), bool), 0
            end = -1
            for s in sorted((s["first"], s["first"] + s["n"] + MATCH - 1) for s in spans or ()):
                keep[s[0]:s[1]] = False
                n_spans += s[0] > end
                end = max(end, s[1])
            left = text[keep].tobytes()
            for column, value in zip(out, (len(text), len(text) - len(left), n_spans, hashlib.sha256(left).hexdigest(), left)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3]), pa.array(out[4], pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Texts are their UTF-8 bytes, whole; null is empty. A byte goes if a
    200-byte string that covers it also starts anywhere else, in the same
    document too; matches do not cross documents. Rows of one id are documents of
    their own, told apart by their texts; rows equal in both repeat each other.
    Rows with a null id are left out. Texts under 200 bytes keep all. An empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    store = Store(docs.sparkSession, "suffix")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
             .withColumn("th", F.xxhash64("text")))
    intervals = repeated_intervals(texts, store)
    spans = (intervals.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("of"))
             .agg(F.collect_set(F.struct("first", "n")).alias("spans")))
    # texts that hold no interval are not shuffled
    marked = Bitmap(store, intervals, "doc_id").mark(texts, F.col("doc_id"), "hit")
    hits = (marked.filter("hit").join(spans, (F.col("doc_id") == F.col("id")) & (F.col("th") == F.col("of")), "left")
            .select("doc_id", "text", "spans"))
    clean = marked.filter("NOT hit").select("doc_id", "text", F.lit(None).cast(hits.schema["spans"].dataType).alias("spans"))
    return (clean.unionAll(hits)
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
