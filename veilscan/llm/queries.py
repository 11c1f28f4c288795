"""Queries of the operators over the driver tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, kd_shards, langid, license_scan, line_dedup, minhash_dedup, packing,
               periodic, quality, sql, suffix_dedup, url_filter, whitening)
from .store import table

QUERIES, SQL = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle() if callable(oracle) else oracle
        return fn
    return register


@query("op10_exact_dedup", sql.EXACT_DEDUP)
def op10(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op5_minhash_dedup", sql.NEAR_DEDUP)
def op5(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op8_decontaminate", sql.DECONTAMINATE)
def op8(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_line_dedup")
def op4(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_url_filter", sql.url_filter)
def op9(spark, sf_dir):
    """A page whose path holds a document's number is bad where that document's quality label is 0."""
    pages = table(spark, sf_dir, "pages")
    numbered = (pages.select("page_id", url_filter.host_path(F.col("url"))[1].alias("path"))
                .select("page_id", F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) AS bigint)").alias("doc_id")))
    labels = (numbered.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
              .select("page_id", (F.col("quality") == 0).cast("int").alias("bad")))
    return url_filter.judge(pages, labels)


@query("op1_language_id")
def op1(spark, sf_dir):
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder == 1)
    return langid.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


@query("op3_license_scan")
def op3(spark, sf_dir):
    return license_scan.summary(license_scan.scan(table(spark, sf_dir, "documents")))


@query("op2_quality")
def op2(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


@query("op7_suffix_dedup", sql.SUFFIX_DEDUP)
def op7(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", periodic.with_planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    out = periodic.periodic_runs(planted)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_kd_shards")
def op12(spark, sf_dir):
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
