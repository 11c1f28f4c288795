"""Intermediate tables in the shared folder: an input that is read more than once is computed once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back; a lost executor costs a re-read.

    The table stays after the call, as the result reads it: give the folder a lifetime rule.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
