"""Report and log sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

# fixed values: the keys of a saved report, in order
REPORT_KEY_ORDER = ["url", "timestamp", "overall_risk", "overall_summary", "gdpr_concerns",
                    "pattern_count", "language_detected", "dark_patterns_found"]


def report_key(url, ts, strip_scheme: bool = False, width: int | None = None) -> Column:
    """File key: non-alphanumerics -> '_', cut to ``width`` chars if given, then ``_yyyyMMdd_HHmmss``."""
    u = col(url)
    if strip_scheme:
        u = F.replace(F.replace(u, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    clean = F.regexp_replace(u, r"[^\p{L}\p{N}]", "_")
    if width:
        clean = F.substring(clean, 1, width)
    return F.concat(clean, F.lit("_"), F.date_format(col(ts), "yyyyMMdd_HHmmss"))


def report_json(reports: DataFrame, url_col: str = "url", ts_col: str = "report_ts") -> Column:
    """One JSON document per report in the fixed key order; nulls are written."""
    doc = F.struct(
        F.col(url_col).alias("url"),
        F.date_format(F.col(ts_col), "yyyyMMdd_HHmmss").alias("timestamp"),
        "overall_risk", "overall_summary", "gdpr_concerns", "pattern_count", "language_detected",
        "dark_patterns_found")
    return F.to_json(doc, {"ignoreNullFields": "false"})


def write_reports(reports: DataFrame, path: str, url_col: str = "url", ts_col: str = "report_ts",
                  mode: str = "overwrite") -> None:
    """Write reports partitioned by risk level: text files with one JSON document per line."""
    out = reports.select(F.col("overall_risk").alias("risk"),
                         report_json(reports, url_col, ts_col).alias("value"))
    out.write.mode(mode).partitionBy("risk").text(path)


def write_report_files(reports: DataFrame, path: str, url_col: str = "url", ts_col: str = "report_ts",
                       mode: str = "overwrite") -> None:
    """One file per report, in a folder named by its key (``report_key=...``).

    Spark's commit protocol moves a task's files when it succeeds, so a task
    that runs twice leaves one file. Reports of one key share a folder.
    """
    out = reports.select(report_key(url_col, ts_col).alias("report_key"), report_json(reports, url_col, ts_col).alias("value"))
    out.write.mode(mode).partitionBy("report_key").text(path)


def read_report_files(spark, path: str) -> DataFrame:
    """(value, report_key) of the files of ``write_report_files``."""
    return spark.read.schema("value string, report_key string").text(path)


def write_log(log: DataFrame, path: str, mode: str = "append") -> None:
    """Append evidence-log rows, partitioned by day."""
    log.withColumn("day", F.to_date("ts")).write.mode(mode).partitionBy("day").parquet(path)
