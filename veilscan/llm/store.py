"""Tables that operators write to the shared folder, to cut lineage and to be read more than once.

The folder is the cluster's ``spark.checkpoint.dir`` (every executor sees it),
so a lost executor costs a re-read, never a wrong or a missing row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Store:
    """Written tables of one run of an operator, each in a folder of its own."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return it as read back; the name only serves people looking at the folder."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._store_path = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again (pass what ``save`` returned)."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._store_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
