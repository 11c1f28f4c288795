"""Quality classifier: document evidence combined with host and path posteriors (hierarchical empirical Bayes).

A logistic regression on shape features, fitted on a bounded sample of the
labelled documents, gives each text's probability of being good. Sites enter
through grouped aggregation over all documents (the label where there is one,
else the probability): a host's mean is shrunk toward the global mean, a path's
toward its host's, each by a strength estimated from the spread between hosts
and between paths (method of moments), so sparse sites say little. A document's
log odds are its own plus the log odds of its path's posterior over the global
ones. ``source`` is the host; its language section is the path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store
from .textbytes import NOT_BLANK, text_slices, word_bounds, word_hashes

#: Bound of the labelled sample the regression is fitted on, in documents.
SAMPLE = 20_000
KEEP = 0.5
#: Sites (host, path) that are broadcast at most.
SITES = 100_000
FEATURES = 12


def _classes() -> list[np.ndarray]:
    b = np.arange(256)
    upper, digit, blank = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), (b == 32) | ((b >= 9) & (b <= 13))
    letter = upper | ((b >= 97) & (b <= 122)) | (b >= 128)
    symbol = ~(letter | digit | blank) & (b >= 33)
    sentence = np.isin(b, [33, 44, 46, 58, 59, 63])
    return [upper, digit, symbol & ~sentence, sentence, b == 33, b == 10]


CLASSES = [c.astype(np.uint8) for c in _classes()]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shape of each text: character classes, word lengths, repetition. An empty text is all zero."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, FEATURES))

    def per_text(values):
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    for j, accept in enumerate(CLASSES):
        out[:, j] = per_text(accept[data]) / np.maximum(size, 1)
    starts, ends = word_bounds(data, offsets, NOT_BLANK)
    bounds = np.searchsorted(starts, offsets)
    hashes = word_hashes(data, starts, ends)
    words = np.diff(bounds)
    lengths = np.concatenate(([0], np.cumsum(ends - starts)))
    out[:, 6] = (lengths[bounds[1:]] - lengths[bounds[:-1]]) / np.maximum(words, 1) / 10
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    for i in np.flatnonzero(words > 0):
        own = hashes[bounds[i]:bounds[i + 1]]
        _, counts = np.unique(own, return_counts=True)
        out[i, 7] = len(counts) / len(own)
        out[i, 8] = counts.max() / len(own)
        inside = same[bounds[i + 1]] - same[bounds[i] + 1]
        out[i, 9] = inside / len(own)
    out[:, 10] = np.log1p(words) / 10
    out[:, 11] = (words == 0)
    return out


def _feature_rows(batches):
    for rows, data, offsets in text_slices(batches):
        x = features(data, offsets)
        yield pa.RecordBatch.from_pydict({"good": rows.column("good"), "x": pa.array(x.tolist(), pa.list_(pa.float64()))})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (last: intercept), feature means and scales; Newton's method with a ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge * len(x) / 100] * x.shape[1] + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """Fit on documents with a non-null quality label, sampled by the id's hash; None without both kinds."""
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    n = known.count()
    if n > SAMPLE:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * SAMPLE / n)
    rows = (docs.select("doc_id", "text").join(known, "doc_id").select(F.col("good").cast("double").alias("good"), "text")
            .mapInArrow(_feature_rows, "good double, x array<double>")).toArrow()
    if not rows.num_rows:
        return None
    y = np.asarray(rows.column("good"))
    if y.min() == y.max():
        return None
    order = np.lexsort((*np.array(rows.column("x").to_pylist()).T, y))  # the sum's order must not depend on the tasks
    return fit_logistic(np.array(rows.column("x").to_pylist())[order], y[order])


def _probabilities(model):
    def run(batches):
        for rows, data, offsets in text_slices(batches):
            x = features(data, offsets)
            if model is None:
                p = np.full(len(x), 0.5)
            else:
                w, mean, scale = model
                p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))
            names = [c for c in rows.schema.names]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(p)], names=[*names, "p_text"])
    return run


def with_text_probability(rows: DataFrame, model) -> DataFrame:
    """``rows`` (with text) and p_text, the probability by the text alone; a null text is judged as empty."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", p_text double"
    return rows.mapInArrow(_probabilities(model), schema)


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_posterior, path_posterior) from (host, path, p), and the global mean."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    both = paths.join(hosts, "host")
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = (total["s"] / total["n"]) if total["n"] else 0.5
    noise = max(mean * (1 - mean), 1e-6)

    def strength(rows: DataFrame, n: str, s: str, centre: Column) -> float:
        """Beta strength whose between-group variance matches the spread beyond sampling noise."""
        r = rows.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - centre) ** 2).alias("spread"), F.count("*").alias("k"), F.sum(n).alias("n")).first()
        if not r["n"]:
            return 1e6
        between = (r["spread"] - noise * r["k"]) / r["n"]
        return min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6

    by_host = strength(hosts, "hn", "hs", F.lit(mean))
    by_path = strength(both, "n", "s", F.col("hs") / F.col("hn"))
    host = (F.col("hs") + by_host * mean) / (F.col("hn") + by_host)
    path = (F.col("s") + by_path * F.col("host_posterior")) / (F.col("n") + by_path)
    return both.withColumn("host_posterior", host).select("host", "path", "host_posterior", path.alias("path_posterior")), mean


def classify(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """Columns of ``carry`` with p_text, host_posterior, path_posterior, p_good and kept (p_good >= 0.5).

    ``docs`` needs doc_id, text, source and lang, ``labels`` doc_id and quality
    (1 good, 0 not; null: no label; of several the best counts). Every row is
    judged, rows that repeat an id too. A null or empty text is judged by its
    (zero) features, a null source or language is a site of its own. Without
    labels of both kinds p_text is 0.5 and all is kept. An empty table gives no
    rows; columns not in ``carry`` do not come back, columns of any name but the
    five new ones can be carried. Sites are broadcast up to ``SITES`` of them.
    """
    store = Store(docs.sparkSession, "quality")
    model = fit(docs, labels)
    host, path = F.coalesce(F.col("source"), F.lit("\0null")), F.coalesce(F.col("lang"), F.lit("\0null"))
    known = labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    plain = with_text_probability(docs.select("doc_id", host.alias("host"), path.alias("path"), "text"), model).drop("text")
    if model is None:
        known = known.limit(0)
    evidence = (store.save(plain, "text").join(known, "doc_id", "left")
                .select("host", "path", F.coalesce(F.col("good").cast("double"), "p_text").alias("p")))
    sites, mean = site_posteriors(evidence)
    sites = store.save(sites, "sites")
    if sites.count() <= SITES:
        sites = F.broadcast(sites)
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    judged = with_text_probability(docs.select(carried.alias("carried"), "text", host.alias("host"), path.alias("path")), model).drop("text")
    judged = judged.join(sites, ["host", "path"])
    odds = _log_odds(F.col("p_text")) + _log_odds(F.col("path_posterior")) - _log_odds(F.lit(mean))
    p = F.lit(1.0) / (1 + F.exp(-odds))
    return judged.select(*[F.col("carried")[c].alias(c) for c in carry], "p_text", "host_posterior", "path_posterior", p.alias("p_good"), (p >= KEEP - 1e-9).alias("kept"))
