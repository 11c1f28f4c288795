"""The skew-safe ordered scan equals a key-partitioned window, hot key included."""
from pyspark.sql import functions as F

from veilscan.operators.scan import Agg, ordered_scan, window_scan

AGGS = [Agg("step", "count"), Agg("run_k", "sum", "k"), Agg("max_v", "max", "value"), Agg("min_k", "min", "k"),
        Agg("any_err", "any", "is_err"), Agg("last_t", "last", "maybe"), Agg("prev_n", "count", frame="before"),
        Agg("prev_max", "max", "value", frame="before"), Agg("prev_any", "any", "is_err", frame="before"),
        Agg("prev_sum", "sum", "k", frame="before")]


def test_scan_equals_window_with_hot_key(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev = (ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")))
          .withColumn("is_err", F.col("event_type") == "error")
          .withColumn("k", F.get_json_object("props", "$.k").cast("long"))
          .withColumn("maybe", F.when(F.col("k") % 4 == 0, F.col("event_type"))))
    cols = ["event_id"] + [a.out for a in AGGS]
    a = {r.event_id: r for r in ordered_scan(ev, "user_id", ["ts", "event_id"], AGGS, num_partitions=7)
         .select(*cols).collect()}
    b = window_scan(ev, "user_id", ["ts", "event_id"], AGGS).select(*cols).collect()
    assert len(a) == len(b)
    for r in b:
        x = a[r.event_id]
        for c in cols:
            u, v = x[c], r[c]
            if isinstance(u, float) and v is not None:
                assert abs(u - v) < 1e-6
            else:
                assert u == v, (r.event_id, c, u, v)


def test_carry_table_is_bounded(spark):
    """A key spread over every partition still needs at most one carry row per partition."""
    df = spark.range(0, 5000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    out = ordered_scan(df, "k", ["o"], [Agg("n", "count")], num_partitions=9)
    got = sorted(r.n for r in out.collect())
    assert got == list(range(1, 5001))


def test_decimal_order(spark):
    df = spark.range(0, 2000).select((F.col("id") % 3).alias("k"), F.col("id").cast("decimal(20,2)").alias("o"),
                                     (F.col("id") % 7).alias("v"))
    aggs = [Agg("n", "count"), Agg("s", "sum", "v")]
    a = sorted(tuple(r) for r in ordered_scan(df, "k", ["o"], aggs, num_partitions=5).collect())
    b = sorted(tuple(r) for r in window_scan(df, "k", ["o"], aggs).collect())
    assert a == b


def test_nulls_and_large_longs(spark):
    """NULL keys, NULL values and longs above 2^53 come out as from the plain window."""
    big = 2 ** 53
    df = spark.range(0, 900).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 5 > 1, F.lit(big) + F.col("id") * 3 + 1).alias("v"),
        F.when(F.col("id") % 7 == 0, F.col("id") % 2 == 0).alias("b"))
    aggs = [Agg("n", "count"), Agg("mx", "max", "v"), Agg("mn", "min", "v"), Agg("l", "last", "v"), Agg("a", "any", "b"),
            Agg("pm", "max", "v", frame="before"), Agg("pl", "last", "v", frame="before")]
    rows = [sorted((tuple(r) for r in f(df, "k", ["o"], aggs).collect()), key=lambda r: r[1]) for f in (ordered_scan, window_scan)]
    assert rows[0] == rows[1] and max(r[5] or 0 for r in rows[0]) > big
