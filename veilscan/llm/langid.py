"""Language identification by nearest centroids of normalised TF-IDF n-gram vectors.

Features are byte n-grams (1 to 3) of the lower-cased text, all but letters
folded to a blank, hashed to ``DIMS`` bins. Document frequencies are counted
over all training documents. Each language's vectors are clustered (spherical
k-means) on a bounded sample into several unit centroids; a document takes the
language of the centroid with the largest cosine and is flagged as rejected
where it lies farther from it than nearly all the training vectors did.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import text_slices

DIMS = 4096
CLUSTERS = 4
#: Bound of the sample that a language's centroids are fitted on, in distinct texts.
SAMPLE = 1500
#: Share of a cluster's sample that may lie beyond its rejection distance, and the slack added to it.
OUTSIDE, MARGIN = 0.005, 0.10
UNKNOWN = "und"

_LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)
_SEED = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)]
_SHIFT = np.uint32(32 - 12)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row per text; n-grams do not cross texts."""
    n = len(offsets) - 1
    folded = _LETTER[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    repeat = np.zeros(len(folded), bool)
    repeat[1:] = (folded[1:] == 32) & (folded[:-1] == 32) & (owner[1:] == owner[:-1])
    folded, owner = folded[~repeat], owner[~repeat]
    total = np.zeros(n * DIMS, np.int64)
    for k in (1, 2, 3):
        if len(folded) < k:
            break
        m = len(folded) - k + 1
        code = np.full(m, k, np.uint32)
        for j in range(k):
            code = code * np.uint32(256) + folded[j:m + j]
        bins = ((code * _SEED[k - 1]) >> _SHIFT).astype(np.int64)
        own = owner[:m]
        inside = own == owner[k - 1:]
        total += np.bincount((own * DIMS + bins)[inside], minlength=n * DIMS)
    return total.reshape(n, DIMS)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts.astype(np.float32) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


def _frequencies(batches):
    df, n = np.zeros(DIMS, np.int64), 0
    for rows, data, offsets in text_slices(batches, rows=256):
        df += (gram_counts(data, offsets) > 0).sum(axis=0)
        n += rows.num_rows
    yield pa.RecordBatch.from_pydict({"bin": pa.array(np.arange(-1, DIMS)), "df": pa.array(np.concatenate(([n], df)))})


def _sampled(idf: np.ndarray):
    def run(batches):
        for rows, data, offsets in text_slices(batches, rows=256):
            x = _vectors(gram_counts(data, offsets), idf)
            yield pa.RecordBatch.from_pydict({"lang": rows.column("lang"), "vector": pa.array([v.tobytes() for v in x], pa.binary())})
    return run


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of spherical k-means (farthest-first start) and their rejection similarities."""
    centre = x.mean(axis=0)
    chosen = [int(np.argmax(x @ centre))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    sims = x @ c.T
    own = np.argmax(sims, axis=1)
    floor = [np.quantile(sims[own == j, j], OUTSIDE) - MARGIN if (own == j).any() else 0.0 for j in range(len(c))]
    return c.astype(np.float32), np.array(floor, np.float64)


def _fit(sample: pa.Table) -> pa.Table:
    vectors = sorted(v.as_py() for v in sample.column("vector"))
    c, floor = cluster(np.frombuffer(b"".join(vectors), np.float32).reshape(-1, DIMS), CLUSTERS)
    return pa.table({"lang": pa.array([sample.column("lang")[0].as_py()] * len(c), pa.string()),
                     "centroid": pa.array([v.tobytes() for v in c], pa.binary()), "floor": pa.array(floor)})


class Model:
    """idf, unit centroids, their languages and rejection similarities (of a size fixed by the languages)."""

    def __init__(self, idf, centroids, langs, floors):
        self.idf, self.centroids, self.langs, self.floors = idf, centroids, langs, floors


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Fit on (text, lang); rows without a language or without a letter teach nothing."""
    usable = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("text", "lang")
    lowered = usable.select(F.lower("text").alias("text"))
    df = dict(lowered.mapInArrow(_frequencies, "bin long, df long").groupBy("bin").agg(F.sum("df").alias("df")).collect())
    if not df.get(-1):
        return Model(None, None, [], None)
    idf = np.array([np.log((1 + df[-1]) / (1 + df.get(b, 0))) + 1 for b in range(DIMS)], np.float32)
    # the sample is drawn by the text's hash, equal texts once
    # (one row per language, always less than the model, which has some centroids of each: broadcast)
    counts = F.broadcast(usable.groupBy("lang").agg(F.count("*").alias("n")))
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)
    picked = (usable.join(counts, "lang").filter(share * F.col("n") < SAMPLE)
              .groupBy("lang", F.xxhash64("text").alias("h")).agg(F.lower(F.first("text")).alias("text")))
    fitted = (picked.select("lang", "text").mapInArrow(_sampled(idf), "lang string, vector binary")
              .groupBy("lang").applyInArrow(_fit, "lang string, centroid binary, floor double")).collect()
    fitted.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    matrix = np.frombuffer(b"".join(bytes(r["centroid"]) for r in fitted), np.float32).reshape(-1, DIMS)
    return Model(idf, matrix, [r["lang"] for r in fitted], np.array([r["floor"] for r in fitted]))


def _predict(model: Model):
    def run(batches):
        for rows, data, offsets in text_slices(batches, rows=256):
            x = _vectors(gram_counts(data, offsets), model.idf)
            sims = x @ model.centroids.T
            best = np.argmax(sims, axis=1)
            score = np.clip(sims[np.arange(len(best)), best], 0, 1).astype(np.float64)
            letters = np.asarray(rows.column("letters"))
            yield pa.RecordBatch.from_pydict({
                "carried": rows.column("carried"),
                "lang_pred": pa.array([model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]),
                "score": pa.array(np.where(letters, score, 0.0)),
                "rejected": pa.array(~letters | (score < model.floors[best]))})
    return run


def predict(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """Columns of ``carry``, lang_pred, score (cosine, 0 to 1), rejected; one row per row.

    Only the text is looked at. A null text, one without a letter, or any text
    where the model learned no language gives ``und``, 0 and rejected. A text of
    any length is used whole; ties go to the first language of the alphabet.
    Repeated rows and ids are judged row by row; an empty table gives no rows.
    Columns of any name but the three new ones can be carried.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    texts = docs.select(carried.alias("carried"), F.lower(F.coalesce("text", F.lit(""))).alias("text"), has_letter(F.col("text")).alias("letters"))
    if not model.langs:
        out = texts.select("carried", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    else:
        kind = texts.schema["carried"].dataType.simpleString()
        out = texts.mapInArrow(_predict(model), f"carried {kind}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col("carried")[c].alias(c) for c in carry], "lang_pred", "score", "rejected")


def identify(docs: DataFrame, train: Column, carry: list[str]) -> DataFrame:
    """Fit on the rows where ``train`` holds, predict every row."""
    return predict(docs, fit(docs.filter(train).select("text", "lang")), carry)
