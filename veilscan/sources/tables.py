"""Input tables: crawl snapshots, model replies, screenshot files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_SCHEMA = "page_id long, url string, html string"


def spread(df: DataFrame) -> DataFrame:
    """Spread a table stored in one row group over the cores (for the small driver tables).

    A file with one row group is read by one task however it is split. The
    readers below never do this: a real table has many files, and its HTML is
    not to cross a shuffle.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, sf_dir: str, name: str, balance: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if balance else df


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawl snapshot (page_id, url, html). Column pruning keeps ``html`` out of
    every query that does not select it."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(PAGES_SCHEMA).format(fmt).load(path)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet", key: str = "site",
                   raw: str = "raw", schema: str | None = None) -> DataFrame:
    """Stored model replies, (key, raw text); json lines, csv or text files also work.

    Text formats are read with an explicit schema (no inference pass over the
    data); ``schema`` overrides the default ``key string, raw string``.
    """
    if fmt == "text":
        df = spark.read.text(path).withColumnRenamed("value", raw)
        return df.withColumn(key, F.input_file_name())
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(schema or f"`{key}` string, `{raw}` string")
        if fmt == "csv":
            reader = reader.option("header", "true").option("multiLine", "true").option("escape", '"')
    return reader.load(path).select(key, raw)


def screenshot_files(spark: SparkSession, path: str, glob: str | None = None,
                     with_content: bool = False) -> DataFrame:
    """Files of a screenshot folder via the ``binaryFile`` source.

    Only path/length/modificationTime are read unless ``with_content`` (then
    ``content_b64`` is the base64 text a multimodal scorer would send).
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    cols = ["path", "length", "modificationTime"]
    if with_content:
        return df.select(*cols, F.base64("content").alias("content_b64"))
    return df.select(*cols)


def existing_shots(manifest: DataFrame, files: DataFrame, path_col: str = "path") -> DataFrame:
    """Manifest rows whose file exists (left semi join on the normalised path)."""
    norm = F.regexp_replace(F.col("path"), "^file:", "")
    f = files.select(norm.alias("_p"))
    return manifest.join(f, F.regexp_replace(F.col(path_col), "^file:", "") == F.col("_p"), "left_semi")
