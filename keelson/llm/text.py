"""Shared column helpers. A word is a run of bytes outside space and \\x09-\\x0D; only A-Z is lower-cased."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def size_of_table(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files that a DataFrame reads, from Spark's own listing; 0 when it isn't read from files."""
    fs_path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    return sum(int((p := fs_path(f)).getFileSystem(conf).getFileStatus(p).getLen()) for f in df.inputFiles())
