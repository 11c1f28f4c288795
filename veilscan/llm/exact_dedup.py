"""Exact dedup by distributed MSD radix partitioning (no digest decides equality).

Round r splits every open group by the next digit of its texts: ``width``
successive bytes of the normalised text, 512 at first (beyond the usual common
first line) and eight times as many each round, so a text of n bytes takes about
log8(n / 512) rounds. A split is one
aggregate over (group, digit) with map-side combine, and one left join of the
open rows with the groups of two or more. A group is closed when it has one
row, or when its digit is shorter than the width: all its texts have ended and
are equal byte for byte. Rows of a hot group stay spread: the aggregate is
combined before the shuffle, and the join is an ordinary sort-merge join whose
skewed partitions AQE may split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

#: Characters that do not count for equality, as a character class.
WHITESPACE = "[\\x20\\x09-\\x0D]"


def without_whitespace(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE + "+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 first_width: int = 512, growth: int = 8) -> DataFrame:
    """One row per input row: its group of equal normalised texts and the row that stays.

    Of a group the row with the most code points in the original text stays,
    then the smallest id. A null text equals the empty one. A null id sorts
    after all others. A row that repeats an id counts in ``group_size`` and
    shares the id's verdict. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    store = Store(docs.sparkSession, "exact")
    norm = without_whitespace(F.col(text_col))
    state = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_cp"),
        F.sha2(F.encode(norm, "UTF-8"), 256).alias("text_sha256"),
        F.encode(norm, "UTF-8").alias("rest"),
        F.lit(0).cast("long").alias("gid"),
    )
    closed, width, prev = [], first_width, None
    while True:
        state = state.withColumn("digit", F.substring("rest", 1, width))
        groups = store.save(
            state.groupBy(F.col("gid").alias("g"), F.col("digit").alias("d"))
            .agg(F.count("*").alias("n"),
                 F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"),
                                F.col("doc_id").alias("id"))).alias("best"))
            .filter("n > 1")
            .select("g", "d", "n", F.col("best.id").alias("keep"),
                    F.monotonically_increasing_id().alias("next_gid")), "groups")
        single, ended = F.col("n").isNull(), F.length("digit") < width
        step = store.save(
            state.join(groups.hint("merge"), (state.gid == groups.g) & (state.digit == groups.d), "left").select(
                "doc_id", "n_cp", "text_sha256",
                F.when(single, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                (single | ended).alias("closed"),
                F.when(~(single | ended), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                F.col("next_gid").alias("gid")), "rows")
        store.drop(groups)
        closed.append(step.filter("closed").select("doc_id", "keep_id", "group_size", "text_sha256"))
        state = step.filter("NOT closed").select("doc_id", "n_cp", "text_sha256", "rest", "gid")
        if state.isEmpty():
            break
        width *= growth
    out = reduce(DataFrame.unionAll, closed)
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
