"""Tables saved in the shared folder between the steps of an operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import use_checkpoints


class Work:
    """A folder of its own for the saved tables of one run. They survive lost executors; drop() removes what isn't needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{use_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        df.write.parquet(f"{self.path}/{name}", compression=compression)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables by name, or the whole folder."""
        for at in [f"{self.path}/{n}" for n in names] or [self.path]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
