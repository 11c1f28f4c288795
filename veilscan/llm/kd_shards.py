"""Shards of nearly equal bytes by a k-d tree over document metadata.

A document is a point: its size and its labels (language, source) as numbers;
documents with equal texts are one point, with the least label of the group. A
node of the tree that is to become k shards is split at the weighted median
(k // 2 of k parts of its bytes) along the dimension in which it is widest,
relative to the whole table, until every leaf is one shard of the target bytes.

Medians are found without a sort: the rows of all nodes of a level are counted
into ``BINS`` ranges of the split value by one aggregate, and the range that
holds the median is divided again, down to one value. Points with that value
are ordered by a hash of their text, and a cut falls between two texts; only a
group of copies that weighs more than ``SLACK`` of a shard is cut itself, by
row number. The driver sees bin counts of at most (shards x BINS) rows.

Places in a shard are a row's number among the rows of its shard in its
partition, plus the counts of earlier partitions, so no shard is one task.
DataFrame functions only; texts are read once and not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Store

#: Ranges that a node's rows are counted into at a time.
BINS = 1024
#: Part of a shard's target bytes up to which a group of equal texts is not cut.
SLACK = 0.002
_HASH_TOP, _ROW_TOP = (1 << 62) - 1, (1 << 63) - 1


def label_number(label: Column) -> Column:
    """A number of its own (up to a 32-bit hash) for every label, -1 for null."""
    return F.coalesce(F.crc32(label.cast("string").cast("binary")), F.lit(-1).cast("long"))


def _values(spark, rows: list[tuple], columns: str) -> DataFrame:
    """An inline table of whole numbers; at most one row per shard, so broadcast."""
    body = ", ".join("(" + ", ".join(f"{int(x)}L" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})"))


def _points(docs: DataFrame, store: Store, id_col: str, text_col: str, labels: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = [f"d{i}" for i in range(1, len(labels) + 1)]
    rows = store.save(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"),
        *[label_number(F.col(c)).alias(d) for c, d in zip(labels, dims)],
        F.monotonically_increasing_id().alias("row")), "rows")
    if dims:
        mixed = " OR ".join(f"min({d}) <> max({d})" for d in dims)
        groups = (rows.groupBy("h").agg(*[F.min(d).alias(f"g{d}") for d in dims], F.expr(mixed).alias("mixed"))
                  .filter("mixed").drop("mixed"))
        named = rows.join(groups, "h", "left")
        rows = store.save(named.select("doc_id", "size", "text_crc32", "h", "row",
                                       *[F.coalesce(f"g{d}", d).alias(d) for d in dims]), "points")
    return rows.withColumn("d0", F.col("size"))


def _value(dims: int) -> Column:
    value = F.col("d0")
    for i in range(1, dims):
        value = F.when(F.col("dim") == i, F.col(f"d{i}")).otherwise(value)
    return value


def _cuts(frame: DataFrame, goals: dict[int, dict], dims: int) -> dict[int, tuple]:
    """Per node the first (value, hash, row) of the right part.

    ``goals``: node -> dim, lo and hi (of its values), goal (bytes of the left
    part), slack (bytes of a group that is not cut).
    """
    spark, cuts = frame.sparkSession, {}
    state = {n: {"stage": 0, "v": 0, "h": 0, "below": 0, **g} for n, g in goals.items()}
    while state:
        for s in state.values():
            s["step"] = (s["hi"] - s["lo"]) // BINS + 1
        asked = _values(spark, [(n, s["dim"], s["stage"], s["v"], s["h"], s["lo"], s["hi"], s["step"]) for n, s in state.items()],
                        "node, dim, stage, v, h0, lo, hi, step")
        of = (frame.join(asked, "node").withColumn("value", _value(dims))
              .filter("stage = 0 OR value = v AND (stage = 1 OR h = h0)")
              .withColumn("at", F.expr("CASE stage WHEN 0 THEN value WHEN 1 THEN h ELSE row END"))
              .filter("at BETWEEN lo AND hi").withColumn("bin", F.expr("(at - lo) DIV step")))
        bins = of.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
        by_node: dict[int, list] = {}
        for r in bins:
            by_node.setdefault(r["node"], []).append(r)
        for n, found in by_node.items():
            s = state[n]
            found.sort(key=lambda r: r["bin"])
            for r in found:
                if s["below"] + r["w"] >= s["goal"] or r is found[-1]:
                    break
                s["below"] += r["w"]
            s["lo"], s["hi"] = r["lo"], r["hi"]
            if r["lo"] < r["hi"]:
                continue
            one, after = r["lo"], s["below"] + r["w"] - s["goal"] < s["goal"] - s["below"]
            if s["stage"] == 0:
                s |= {"stage": 1, "v": one, "lo": 0, "hi": _HASH_TOP}
            elif s["stage"] == 2:
                cuts[n] = (s["v"], s["h"], one + after)
            elif r["w"] <= s["slack"]:
                cuts[n] = (s["v"], one + after, 0)
            else:
                s |= {"stage": 2, "h": one, "lo": 0, "hi": _ROW_TOP}
        state = {n: s for n, s in state.items() if n not in cuts}
    return cuts


def kd_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
              labels: tuple[str, ...] = ("lang", "source"), slack: float = SLACK) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1 (null and empty text: 1),
    ``text_crc32`` that of the bytes, ``law`` is "bytes": each split leaves less
    than ``slack`` of a shard, or than the one text that the cut falls on, between
    the two sides' bytes and their due. ``slot`` counts a shard's rows from 0. A
    null label is a label of its own; repeated ids and rows and null ids are rows
    like others; ``grown_shard`` is null. A shard can be empty where there are
    fewer rows than shards; an empty table gives no rows. Columns other than
    the id, the text and ``labels`` are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "shards")
    frame = _points(docs, store, id_col, text_col, labels).withColumn("node", F.lit(0).cast("long"))
    dims = len(labels) + 1
    leaves = {0: (0, shards)}  # node -> (first shard, shards)
    spread = None
    while any(k > 1 for _, k in leaves.values()):
        stats = {r["node"]: r for r in frame.groupBy("node").agg(
            F.sum("size").alias("w"), *[f(f"d{i}").alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)]).collect()}
        if spread is None:
            spread = [max(stats[0][f"max{i}"] - stats[0][f"min{i}"], 1) if stats else 1 for i in range(dims)]
        goals = {}
        for n, r in stats.items():
            k = leaves[n][1]
            if k > 1:
                width = [(r[f"max{i}"] - r[f"min{i}"]) / spread[i] for i in range(dims)]
                dim = max(range(dims), key=lambda i: (width[i], -i))
                goals[n] = {"dim": dim, "lo": r[f"min{dim}"], "hi": r[f"max{dim}"],
                            "goal": r["w"] * (k // 2) / k, "slack": slack * r["w"] / k}
        # rows of nodes that are not split go on as the left child
        cuts = _cuts(frame, goals, dims) if goals else {}
        split = _values(spark, [(n, goals[n]["dim"], *cuts[n]) if n in cuts else (n, 0, _ROW_TOP, 0, 0) for n in leaves], "node, dim, v, h0, r0")
        value = _value(dims)
        right = (value > F.col("v")) | ((value == F.col("v")) & ((F.col("h") > F.col("h0")) | ((F.col("h") == F.col("h0")) & (F.col("row") >= F.col("r0")))))
        frame = frame.join(split, "node").withColumn("node", F.col("node") * 2 + right.cast("long")).drop("dim", "v", "h0", "r0")
        leaves = {c: part for n, (first, k) in leaves.items() for c, part in (
            [(2 * n, (first, k // 2)), (2 * n + 1, (first + k // 2, k - k // 2))] if k > 1 else [(2 * n, (first, k))])}
    named = frame.join(_values(spark, [(n, first) for n, (first, _) in leaves.items()], "node, shard"), "node")
    placed = store.save(named.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "row",
                                     F.shiftright("row", 33).alias("part")), "placed")
    before = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = before.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("row"))
    ranked = placed.withColumn("rank", rank).join(before, ["shard", "part"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
