"""Training-corpus pipeline: from documents to packed sequences.

Each stage takes all that its predecessor kept, written as Parquet and read
again; all but the last return the columns of documents.

1. quality: documents that the quality classifier rejects go.
2. lines: of each group of like lines one occurrence stays; a document that
   loses every line goes.
3. near duplicates: of each group of documents linked at a shingle similarity
   of 0.8 or more the one with the smallest id stays.
4. decontamination: documents that hold a ten-word window of a benchmark item go.
5. packing: what is left, cut and placed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import decontaminate, line_dedup, minhash_dedup, packing, quality
from veilscan.llm.store import Store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=COLUMNS).filter("kept").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs, carry=["lang", "source", "n_chars"])
    length = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    word = F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")
    return out.filter((F.col("n_removed") == 0) | word).withColumn("n_chars", length.cast("long")).select(COLUMNS)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    return docs.join(dropped.select("doc_id"), "doc_id", "left_anti").select(COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, minhash_dedup.near_duplicates(docs, percent=80).filter("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = store.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising and packing have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None
