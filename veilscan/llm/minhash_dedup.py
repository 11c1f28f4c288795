"""Near-duplicate documents: MinHash samples folded into odd sketches, banded candidates, exact check.

Per document, ``BANDS * ROWS`` MinHash values of its distinct word shingles
give a key per band, where candidates meet. Its bottom-k MinHash sample (the
``SAMPLE`` least shingle hashes; all of a smaller set) is folded into an odd
sketch: a bitmap in which every sampled hash toggles one bit. The population
count of the XOR of two sketches counts the samples that only one side has,
precisely where similarity is high. Bits can only cancel, so a count beyond
what the threshold allows excludes a pair for certain where both sets are
whole samples, and beyond six standard errors else. What remains is confirmed
on the full shingle sets.
Documents with equal sets meet by a 128-bit digest of the set first, so a large
group of copies enters the search as one row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linkage import linked
from .store import Store
from .textbytes import NOT_BLANK, mix, shingles, slice_words, text_slices

WORDS = 5
BANDS, ROWS = 32, 5
SKETCH_BITS = 1024
SAMPLE = 1024

_rng = np.random.default_rng(5)
_MUL = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_FOLD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNATURE = ("doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, "
             + ", ".join(f"s{i} long" for i in range(SKETCH_BITS // 64)))
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


def minhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum of each of the sample hashes over each document (no document may be empty)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, len(_MUL)), np.uint32)
    for j in range(len(_MUL)):
        out[:, j] = np.minimum.reduceat(x * _MUL[j] + _ADD[j], bounds[:-1])
    return out


def odd_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmap of the bottom-k sample of each sorted set, as int64 words."""
    out = np.empty((len(sets), SKETCH_BITS // 8), np.uint8)
    for i, hashes in enumerate(sets):
        bits = (mix(hashes[:SAMPLE]) % np.uint64(SKETCH_BITS)).astype(np.int64)
        out[i] = np.packbits((np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8))
    return out.view(np.int64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    n = len(samples)
    folded = (samples.astype(np.uint64) * _FOLD).reshape(n, BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return mix(folded + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def most_differing(n_a: Column, n_b: Column, percent: int) -> Column:
    """Largest XOR population count of two sketches whose sets may reach the similarity."""
    k_a, k_b, most = F.least(n_a, F.lit(SAMPLE)), F.least(n_b, F.lit(SAMPLE)), F.greatest(n_a, n_b)
    both = (n_a + n_b) * (percent / (100 + percent))  # least size of the intersection
    expected = k_a + k_b - 2 * both * F.least(F.lit(1.0), F.lit(float(SAMPLE)) / most)
    return F.when(most <= SAMPLE, expected + 0.001).otherwise(expected + 6 * F.sqrt(expected) + 10)


def _signatures(batches):
    for rows, data, offsets in text_slices(batches):
        words, bounds = slice_words(data, offsets, NOT_BLANK)
        hashes, ends = shingles(words, bounds, WORDS)
        sets = [np.unique(hashes[ends[i]:ends[i + 1]]) for i in range(rows.num_rows)]
        size = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(size)
        out = {"doc_id": rows.column("doc_id"), "n_shingles": pa.array(size)}
        d1, d2 = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        keys = np.zeros((len(size), BANDS), np.int64)
        bits = np.zeros((len(size), SKETCH_BITS // 64), np.int64)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            at = np.concatenate(([0], np.cumsum(size[full])))
            d1[full] = np.add.reduceat(mix(flat + np.uint64(1)), at[:-1]).view(np.int64)
            d2[full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at[:-1]).view(np.int64)
            samples = minhash(flat, at)
            keys[full], bits[full] = band_keys(samples), odd_sketch([sets[i] for i in full])
        out |= {"d1": pa.array(d1), "d2": pa.array(d2)}
        out["bands"] = pa.ListArray.from_arrays(pa.array(np.arange(0, len(size) * BANDS + 1, BANDS, dtype=np.int32)),
                                               pa.array(keys.ravel()))
        out |= {f"s{i}": pa.array(np.ascontiguousarray(bits[:, i])) for i in range(bits.shape[1])}
        yield pa.RecordBatch.from_pydict(out)


def _full_sets(batches):
    for rows, data, offsets in text_slices(batches):
        words, bounds = slice_words(data, offsets, NOT_BLANK)
        hashes, ends = shingles(words, bounds, WORDS)
        yield pa.RecordBatch.from_pydict({
            "doc_id": rows.column("doc_id"),
            "shingles": pa.array([np.unique(hashes[ends[i]:ends[i + 1]]).tobytes() for i in range(rows.num_rows)], pa.binary())})


def _similar(percent: int):
    def check(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (a, b))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    return check


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its group of texts of similarity ``percent`` / 100 or more.

    Words are maximal runs of other than ASCII blanks, A-Z lower-cased; a
    document's set holds its distinct 5-word shingles, or its whole sequence
    where it has fewer words. Columns: doc_id, n_shingles, component_id (the
    smallest id reachable over links), kept. A null or blank text has the empty
    set and links with nothing. Ids are to be unique and not null: rows that
    repeat an id count as one document, rows without an id are left out. An
    empty table gives no rows; other columns of ``docs`` are not read.

    A pair at the threshold 0.80 shares no band with probability 3e-6, at 0.85
    with 7e-9.
    """
    spark = docs.sparkSession
    store = Store(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    sig = store.save(texts.mapInArrow(_signatures, SIGNATURE), "signatures")
    sets = sig.filter("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    sets = store.save(sets, "sets")
    reps = store.save(sig.join(sets.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
                      .dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "id"), "representatives")
    members = reps.select("id", F.explode("bands").alias("key"))
    prepared = {}

    def near(a, b):
        xor = reduce(lambda x, y: x + y, [F.bit_count(a(s).bitwiseXOR(b(s))) for s in SKETCH])
        low, high = F.least(a("n_shingles"), b("n_shingles")), F.greatest(a("n_shingles"), b("n_shingles"))
        return (low * 100 >= high * percent) & (xor <= most_differing(a("n_shingles"), b("n_shingles"), percent))

    def prepare(ids):
        wanted = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        prepared["sets"] = store.save(wanted.mapInArrow(_full_sets, "doc_id long, shingles binary"), "shingles")

    def confirm(pairs):
        full = prepared["sets"]
        both = (pairs.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
                .join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b"))
        return both.select("a", "b", "set_a", "set_b").mapInArrow(_similar(percent), "a long, b long")

    labels = linked(store, members, reps.select("id", "n_shingles", *SKETCH), near, confirm, prepare)
    own = sig.select("doc_id", "n_shingles", "d1", "d2").join(sets, ["n_shingles", "d1", "d2"], "left")
    if labels is None:
        own = own.withColumn("component", F.col("rep"))
    else:
        own = own.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    out = own.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))
