"""Corpus pipeline: quality classifier, quality rules, near-dedup, source mixing, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that the one before kept. All stages
decide on narrow tables and take the rows by a join, so texts are shuffled once and never saved in between.
Rows are named by a hash of their values, so a verdict belongs to a row and not to an id: equal rows share theirs, rows
of one id with unlike texts have one each, and null ids are no group. Empty tables stay empty; extra columns are
carried, whatever their names; null and very long texts are judged like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import classifier, mixing, near_dedup, packing, quality_rules
from keelson.llm.text import table
from keelson.session import use_checkpoints

#: Columns that a stage reads; a table without one of them has nulls there.
READ = ["doc_id", "text", "lang", "source"]


def _narrow(docs: DataFrame) -> DataFrame:
    """name and the columns READ. Values of other columns take part in the name."""
    missing = [F.lit(None).cast("bigint" if c == "doc_id" else "string").alias(c) for c in READ if c not in docs.columns]
    return docs.select(F.xxhash64(*docs.columns).alias("name"), *[c for c in READ if c in docs.columns], *missing)


def _take(docs: DataFrame, kept: DataFrame, once: bool = False) -> DataFrame:
    """The rows whose name is among kept (name); of equal rows all, or one, which each task picks before the shuffle."""
    rows = docs.select(F.xxhash64(*docs.columns).alias("name"), F.struct(*docs.columns).alias("row"))
    if once:
        rows = rows.groupBy("name").agg(F.first("row").alias("row"))
    return rows.join(kept.select("name").distinct(), "name", "left_semi").select("row.*")


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    judged = classifier.classify(_narrow(docs).select("name", "doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _take(docs, judged.filter("predicted = 1"))


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the outlier test."""
    judged = quality_rules.judge(_narrow(docs), ["name"])
    return _take(docs, judged.filter("kept"))


def by_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id (null last), then of the smallest name. Of
    equal rows one stays; documents without words, which link with nothing, all stay."""
    rows = _narrow(docs)
    groups = near_dedup.near_duplicates(rows.select(F.col("name").alias("doc_id"), "text")).select(F.col("doc_id").alias("name"), F.col("component_id").alias("group")).distinct()
    named = groups.join(rows.select("name", "doc_id").distinct(), "name")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "name")).alias("first")
    return _take(docs, named.groupBy("group").agg(first).select("first.name"), once=True)


def by_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: repeated documents as rows of their own, partly taken ones with the words taken."""
    return mixing.mixed_documents(docs)


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces; the number in document tells repeats of a doc_id apart."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", by_classifier),
    ("quality_rules", by_rules),
    ("near_dedup", by_near_dedup),
    ("source_mixing", by_mixing),
    ("packing", by_packing),
]
#: Kernel features, distance cut-offs, components and tokens have no SQL form; tests rebuild each decision instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{use_checkpoints(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
