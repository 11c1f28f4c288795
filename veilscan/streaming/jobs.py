"""Structured Streaming jobs: the same DataFrame functions over arriving files.

Each job reads a folder with ``readStream`` (schema given, no inference),
applies the batch operators unchanged, and writes to a folder the caller names,
with the checkpoint beside it, so a restarted or failed-over job resumes
exactly where it stopped. ``available_now=True`` processes what is
there and stops (what tests and backfills use); otherwise a processing-time
trigger keeps the job running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators.audit import page_evidence

PAGES_SCHEMA = "page_id long, url string, html string"


def _trigger(writer, available_now: bool, every: str = "30 seconds"):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)


def read_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None) -> DataFrame:
    """Files of a folder as they land; ``glob`` names them, or the tables there, as one file or a folder of part files."""
    # as a pattern, for the source takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{{{glob}}}" if glob else folder)


def stream_signals(spark: SparkSession, in_dir: str, out_dir: str, glob: str = "pages.parquet",
                   available_now: bool = True) -> str:
    """Score pages as they land: features + lexicon signals, appended to ``out_dir``."""
    pages = read_stream(spark, in_dir, PAGES_SCHEMA, glob)
    pe = page_evidence(pages).select("page_id", "host", "urgency_texts", "subscription_keywords",
                                     "consent_accept", "consent_reject", "popup_detected")
    q = _trigger(pe.writeStream.format("parquet").option("path", out_dir)
                 .option("checkpointLocation", out_dir + "_ckpt").outputMode("append"), available_now).start()
    if available_now:
        q.awaitTermination()
    return out_dir


def stream_site_evidence(spark: SparkSession, log: DataFrame, out_dir: str,
                         available_now: bool = True) -> str:
    """Running accumulator per site over a streaming log (update mode).

    Every micro-batch writes the sites it changed under ``epoch=N``, replacing
    that folder if the batch is run again; ``current_state`` reads the latest
    row of each site.

    Streaming state holds one row per site (counters and flags only), so the
    state size is bounded by the number of sites, never by their log length.
    """
    signal = ((F.size("urgency_texts") > 0) | (F.size("subscription_keywords") > 0)
              | (F.size("dark_pattern_hints") > 0) | (F.size("preselected") > 0)
              | F.col("popup") | F.col("reject_missing"))
    agg = log.groupBy("site").agg(
        F.count(F.lit(1)).alias("step_count"),
        F.count("shot_path").alias("screenshots_taken"),
        F.coalesce(F.bool_or("popup"), F.lit(False)).alias("popup_detected"),
        F.coalesce(F.bool_or("reject_missing"), F.lit(False)).alias("reject_button_missing"),
        F.sum(F.size("urgency_texts")).alias("n_urgency_texts"),
        F.bool_or(F.col("visited").isNotNull()).alias("_visited"),
        F.bool_or(signal).alias("_signals"))
    # the evidence rule on running state: a screenshot, a visited page, six steps, a signal
    agg = agg.withColumn("enough", (F.col("screenshots_taken") > 0) & F.col("_visited")
                         & (F.col("step_count") >= E.MIN_STEPS) & F.col("_signals")).drop("_visited", "_signals")

    def write(batch: DataFrame, epoch: int):
        batch.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")

    q = _trigger(agg.writeStream.outputMode("update").foreachBatch(write)
                 .option("checkpointLocation", out_dir + "_ckpt"), available_now).start()
    if available_now:
        q.awaitTermination()
    return out_dir


def current_state(spark: SparkSession, out_dir: str) -> DataFrame:
    """The latest row of each site that ``stream_site_evidence`` wrote."""
    rows = spark.read.parquet(out_dir)
    cols = [c for c in rows.columns if c not in ("site", "epoch")]
    return rows.groupBy("site").agg(F.max_by(F.struct(*cols), "epoch").alias("s")).select("site", "s.*")


def stream_dedupe(spark: SparkSession, visits: DataFrame, out_dir: str, delay: str,
                  available_now: bool = True) -> str:
    """Each (site, url) once: ``dropDuplicatesWithinWatermark`` keeps state for ``delay`` only."""
    d = visits.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["site", "url"])
    q = _trigger(d.writeStream.format("parquet").option("path", out_dir)
                 .option("checkpointLocation", out_dir + "_ckpt").outputMode("append"), available_now).start()
    if available_now:
        q.awaitTermination()
    return out_dir
