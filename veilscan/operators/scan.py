"""Ordered per-key running aggregates that never put one key in one task.

``Window.partitionBy(site).orderBy(ts)`` sends every row of a site to one
task; a site holding a third of all rows would make that task hold a third of
the data. ``ordered_scan`` computes the same running values in four steps:

1. the input is written once to the shared folder, so that its sources are read
   once; chunk boundaries come from a seeded sample of that table's (key, order)
   columns, cut into ``n`` ranges (about 20 sampled rows per chunk reach the driver);
2. each row's chunk: a binary search of its own (key, order) values over the
   boundaries (one broadcast row), so the chunk id is a pure function of the row,
   the same in every pass, and a hot key simply spans many chunks;
3. Spark's own window functions over (chunk, key) for the local values;
4. per (chunk, key) totals from a column-pruned aggregate; for every key the
   combined totals of its earlier chunks. Only the first key of a chunk can
   continue from an earlier one, so the carry table has fewer rows than
   chunks and is broadcast.

Supported operators (all associative): ``count`` (running row number),
``sum``, ``max``, ``min``, ``any`` (boolean or) and ``last`` (last non-null
value). Frame ``"upto"`` includes the current row, ``"before"`` excludes it.
A null key is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shuffle_partitions
from ..sources.scratch import written

OPS = ("count", "sum", "max", "min", "any", "last")


@dataclass(frozen=True)
class Agg:
    out: str
    op: str
    col: str | None = None
    frame: str = "upto"


def _spark_type(df: DataFrame, a: Agg):
    if a.op == "count":
        return T.LongType()
    if a.op == "any":
        return T.BooleanType()
    return df.schema[a.col].dataType


def _running(df: DataFrame, window, aggs: list[Agg]) -> DataFrame:
    """Built-in running aggregates over an ordered window, null where no row is in the frame."""
    out = df
    for a in aggs:
        frame = window.rowsBetween(Window.unboundedPreceding, 0 if a.frame == "upto" else -1)
        if a.op == "count":
            e = F.count(F.lit(1)).over(frame)
        elif a.op == "any":
            e = F.coalesce(F.bool_or(a.col).over(frame), F.lit(False))
        elif a.op == "last":
            e = F.last(a.col, ignorenulls=True).over(frame)
        else:
            e = {"sum": F.sum, "max": F.max, "min": F.min}[a.op](a.col).over(frame)
        out = out.withColumn(a.out, e.cast(_spark_type(df, a)))
    return out


def window_scan(df: DataFrame, key: str, order: list[str], aggs: list[Agg]) -> DataFrame:
    """The same values by a key-partitioned window: what tests compare with."""
    return _running(df, Window.partitionBy(key).orderBy(*order), aggs)


def _norm(df: DataFrame, c: str):
    """A comparable form of a key/order column (string or number), monotone in
    Spark's ordering with nulls first; None if the type has no literal form."""
    t = df.schema[c].dataType
    col = F.col(c)
    if isinstance(t, T.StringType):
        return F.coalesce(col, F.lit("")), "s"
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return F.coalesce(col.cast("long"), F.lit(-(2 ** 63)).cast("long")), "n"
    if isinstance(t, T.DecimalType):
        return F.coalesce(col, F.lit("-" + "9" * (t.precision - t.scale or 1)).cast(t)), t.simpleString()
    if isinstance(t, T.BooleanType):
        return F.coalesce(col.cast("long"), F.lit(-1).cast("long")), "n"
    if isinstance(t, T.DoubleType) or isinstance(t, T.FloatType):
        return F.coalesce(col.cast("double"), F.lit(float("-inf"))), "d"
    if isinstance(t, T.TimestampType):
        return F.coalesce(F.unix_micros(col), F.lit(-(2 ** 63)).cast("long")), "n"
    if isinstance(t, (T.TimestampNTZType, T.DateType)):
        fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS" if isinstance(t, T.TimestampNTZType) else "yyyy-MM-dd"
        return F.coalesce(F.date_format(col, fmt), F.lit("")), "s"
    return None


def ordered_scan(df: DataFrame, key: str, order: list[str], aggs: list[Agg],
                 num_partitions: int | None = None) -> DataFrame:
    """Running per-key aggregates in ``order`` (must be a total order within a key).

    The input is written once; everything else reads that table. Running values
    inside a chunk are window functions over (chunk, key); per-chunk totals (a
    column-pruned aggregate) give every key the carry of its earlier chunks. At
    most one key per chunk continues from earlier chunks, so the carry table has
    fewer rows than chunks and is broadcast. The call runs the jobs that write
    and sample the table.
    """
    for a in aggs:
        if a.op not in OPS:
            raise ValueError(f"unsupported op {a.op}")
    norms = [_norm(df, c) for c in [key, *order]]
    if any(x is None for x in norms):
        raise TypeError(f"no total order known for one of {[key, *order]}")
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    names = [f"c{i}" for i in range(len(norms))]
    value = F.struct(*[e.alias(nm) for nm, (e, _) in zip(names, norms)])
    df = written(df, "scan")
    # 1. boundaries from a bounded, seeded sample (about 20 rows per chunk); the count reads file footers
    fraction = min(1.0, 20.0 * n / max(df.count(), 1))
    sample = df.select(value.alias("v")).sample(withReplacement=False, fraction=fraction, seed=20241202)
    drawn = [r["v"] for r in sample.orderBy("v").collect()]
    cuts = list(dict.fromkeys(drawn[min(len(drawn) - 1, j * len(drawn) // n)] for j in range(1, n))) if drawn else []
    # 2. chunk id: a deterministic function of each row's own values
    if cuts:
        kind = T.StructType([T.StructField("_b", T.ArrayType(sample.schema["v"].dataType)), T.StructField("_all", T.IntegerType())])
        bounds = F.broadcast(spark.createDataFrame([(cuts, 0)], kind))
        mid = "CAST((acc.lo + acc.hi) div 2 AS INT)"
        search = (f"aggregate(sequence(1, {len(cuts).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(cuts)}), (acc, i) -> "
                  f"CASE WHEN acc.lo < acc.hi THEN (CASE WHEN element_at(_b, {mid} + 1) <= _cv "
                  f"THEN named_struct('lo', {mid} + 1, 'hi', acc.hi) "
                  f"ELSE named_struct('lo', acc.lo, 'hi', {mid}) END) ELSE acc END).lo")
        with_cuts = df.withColumn("_all", F.hash(key).bitwiseAND(0)).join(bounds, "_all").withColumn("_cv", value)
        chunked = with_cuts.withColumn("_chunk", F.expr(search)).drop("_cv", "_b", "_all")
    else:
        chunked = df.withColumn("_chunk", F.lit(0))
    # 3. local running values per (chunk, key)
    local = _running(chunked, Window.partitionBy("_chunk", key).orderBy(*order), aggs)
    # 4. totals per (chunk, key) -> carry of the earlier chunks of each key
    tot_exprs = []
    for a in aggs:
        if a.op == "count":
            tot_exprs.append(F.count(F.lit(1)).alias(a.out))
        elif a.op == "sum":
            tot_exprs.append(F.sum(a.col).alias(a.out))
        elif a.op == "max":
            tot_exprs.append(F.max(a.col).alias(a.out))
        elif a.op == "min":
            tot_exprs.append(F.min(a.col).alias(a.out))
        elif a.op == "any":
            tot_exprs.append(F.coalesce(F.bool_or(a.col), F.lit(False)).alias(a.out))
        else:
            tot_exprs.append(F.max_by(F.col(a.col), F.when(F.col(a.col).isNotNull(),
                                                            F.struct(*order))).alias(a.out))
    tot = chunked.groupBy("_chunk", key).agg(*tot_exprs)
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = []
    for a in aggs:
        c = F.col(a.out)
        if a.op in ("count", "sum"):
            e = F.sum(c).over(earlier)
        elif a.op == "max":
            e = F.max(c).over(earlier)
        elif a.op == "min":
            e = F.min(c).over(earlier)
        elif a.op == "any":
            e = F.bool_or(c).over(earlier)
        else:
            e = F.last(c, ignorenulls=True).over(earlier)
        carry_cols.append(e.alias("_c_" + a.out))
    first = F.min("_chunk").over(Window.partitionBy(key))
    carry = (tot.select("_chunk", key, first.alias("_first"), *carry_cols)
             .filter(F.col("_chunk") > F.col("_first")).drop("_first"))
    # fewer carry rows than chunks (one continuing key per chunk at most): broadcast
    carry = carry.withColumnsRenamed({"_chunk": "_cc", key: "_ck"})
    joined = local.join(F.broadcast(carry), (F.col("_chunk") == F.col("_cc")) & F.col(key).eqNullSafe(F.col("_ck")), "left")
    return joined.select(*[F.col(c) for c in df.columns], *_combine_cols(df, aggs))


def _combine_cols(df: DataFrame, aggs: list[Agg]):
    out = []
    for a in aggs:
        loc, car = F.col(a.out), F.col("_c_" + a.out)
        if a.op in ("count", "sum"):
            e = F.when(car.isNull(), loc).otherwise(F.coalesce(loc, F.lit(0)) + car)
        elif a.op == "max":
            e = F.greatest(loc, car)
        elif a.op == "min":
            e = F.least(loc, car)
        elif a.op == "any":
            e = F.coalesce(loc, F.lit(False)) | F.coalesce(car, F.lit(False))
        else:
            e = F.coalesce(loc, car)
        out.append(e.cast(_spark_type(df, a)).alias(a.out))
    return out
