"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in code-point order (null last) have weights 3, 1, 2, repeating, and share TOTAL times all words; a target
stops at MAX_REPEAT times its source's words and its excess is shared again. Each source is dealt into shards of about
SHARD_DOCS documents by a seeded hash of doc_id and text, and a shard's documents, in the order of that hash, form a
stream cut into blocks of BLOCK words. Highest quotients give each source, then each of its shards, an integer number of
blocks; a shard takes whole passes first, then the blocks that a seeded permutation of the block numbers selects.

All decisions are made on narrow rows, and every one is a function of the seed, the id and the text, so reruns agree.
A row per source meets in one task and a row per shard in one task per source; both tables are saved and joined,
and Spark broadcasts them only below its size threshold. Nothing of them reaches the driver.

Null text has no words; such documents, and sources without words, take nothing. Null ids are dealt by their texts.
Repeated rows each have their own place in the stream, an empty table gives an empty one, a very long text is cut at its
blocks like any other, and columns named as the added ones are replaced; any other names may clash.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Work
from .text import table, words

WEIGHTS = (3, 1, 2)
TOTAL, MAX_REPEAT = 1.5, 2
BLOCK, SEED = 64, 20
SHARD_DOCS = 2000
SOURCES = "k int, source string, words bigint, target double, quota bigint, shards bigint"
SHARDS = "k int, shard bigint, passes bigint, chosen bigint, blocks bigint, step bigint, shift bigint"
ADDED = ["size", "source_size", "target", "taken", "passes", "chosen", "blocks", "step", "shift", "begin"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: Sequence[int]) -> list[float]:
    """Target words of sources in order."""
    left, out, open_ = TOTAL * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = left / sum(WEIGHTS[i % len(WEIGHTS)] for i in open_)
        full = {i for i in open_ if share * WEIGHTS[i % len(WEIGHTS)] > MAX_REPEAT * sizes[i]}
        if not full:
            for i in open_:
                out[i] = share * WEIGHTS[i % len(WEIGHTS)]
            break
        for i in full:
            out[i] = float(MAX_REPEAT * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def apportion(votes: Sequence[float], seats: int) -> list[int]:
    """Sainte-Laguë: seats go to the highest quotients votes / (2 s + 1); the first wins a tie."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    d = total / seats
    while sum(out := [math.floor(v / d + 0.5) for v in votes]) > seats:
        d *= 1 + 0.5 / seats
    # d gave no seat too many; at most about one a party is left for the quotients themselves
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heap[0]
        out[i] += 1
        heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def plan_shard(n_words: int, quota: int, seed: int) -> tuple[int, int, int, int, int]:
    """(passes, chosen, blocks, step, shift): block b is taken once more when (b step + shift) mod blocks < chosen."""
    blocks = -(-n_words // BLOCK)
    if not n_words:
        return 0, 0, 1, 1, 0
    take = min(quota * BLOCK, MAX_REPEAT * n_words)
    passes, rest = divmod(take, n_words)
    chosen = round(rest / BLOCK)
    if chosen >= blocks:
        passes, chosen = passes + 1, 0
    step = max(1, round(0.618 * blocks))
    while math.gcd(step, blocks) > 1:
        step += 1
    return passes, chosen, blocks, step, seed * 7919 % blocks


def plan_sources(t: pd.DataFrame) -> pd.DataFrame:
    """SOURCES of (source, words, shards)."""
    t = t.assign(source=t["source"].where(t["source"].notna(), None))
    t = t.iloc[sorted(range(len(t)), key=lambda i: (t["source"].iloc[i] is None, t["source"].iloc[i] or ""))]
    goals = targets(t["words"].tolist())
    return pd.DataFrame({"k": range(len(t)), "source": t["source"].tolist(), "words": t["words"].tolist(), "target": goals, "quota": apportion(goals, round(sum(goals) / BLOCK)), "shards": t["shards"].tolist()})


def plan_shards(t: pd.DataFrame) -> pd.DataFrame:
    """SHARDS of one source's (k, quota, shard, words)."""
    t = t.sort_values("shard")
    quotas = apportion(t["words"].tolist(), int(t["quota"].iloc[0]))
    rows = [(k, shard, *plan_shard(w, q, SEED + k + shard)) for k, shard, w, q in zip(t["k"].tolist(), t["shard"].tolist(), t["words"].tolist(), quotas, strict=True)]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SHARDS.split(", ")])


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text and more) with text replaced by size, source_size, target, taken and the columns of its selection."""
    work = Work(docs.sparkSession, "mix")
    keep = [c for c in docs.columns if c not in ("text", *ADDED)]
    size = F.size(words(F.coalesce("text", F.lit("")))).cast("bigint").alias("size")
    d = work.save(docs.select(F.struct(*keep).alias("row"), "doc_id", "source", size, F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h")), "sizes")
    by_source = d.groupBy("source").agg(F.sum("size").alias("words"), F.ceil(F.count("*") / SHARD_DOCS).alias("shards"))
    sources = work.save(by_source.groupBy().applyInPandas(plan_sources, SOURCES), "sources")
    named = sources.withColumnRenamed("source", "_source")
    d = d.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.shiftright("h", 20), F.col("shards")))
    by_shard = d.groupBy("k", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    plan = work.save(by_shard.groupBy("k").applyInPandas(plan_shards, SHARDS), "shards")
    w = Window.partitionBy("k", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(plan, ["k", "shard"]).withColumn("begin", F.sum("size").over(w) - F.col("size"))
    end = F.col("begin") + F.col("size")
    numbers = F.when((F.col("chosen") > 0) & (F.col("size") > 0), F.sequence(F.expr(f"begin div {BLOCK}"), F.expr(f"(begin + size - 1) div {BLOCK}"))).otherwise(F.array().cast("array<bigint>"))

    def part(n, b):
        hit = F.pmod(b * F.col("step") + F.col("shift"), F.col("blocks")) < F.col("chosen")
        return n + F.when(hit, F.least(end, (b + 1) * BLOCK) - F.greatest(F.col("begin"), b * BLOCK)).otherwise(F.lit(0).cast("bigint"))

    taken = F.col("passes") * F.col("size") + F.aggregate(numbers, F.lit(0).cast("bigint"), part)
    return d.withColumns({"taken": taken, "source_size": F.col("words")}).select("row.*", *ADDED)


def selected_text(text: str, begin: int, chosen: int, blocks: int, step: int, shift: int) -> str:
    """The words of the document's selected blocks; a run of blocks keeps its own white space, runs are joined by a newline."""
    spans = [m.span() for m in WORD.finditer(text)]
    runs: list[list[int]] = []
    for b in range(begin // BLOCK, (begin + len(spans) - 1) // BLOCK + 1):
        if (b * step + shift) % blocks < chosen:
            lo, hi = max(0, b * BLOCK - begin), min(len(spans), (b + 1) * BLOCK - begin)
            if runs and runs[-1][1] == lo:
                runs[-1][1] = hi
            else:
                runs.append([lo, hi])
    return "\n".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in runs)


def row_name(docs: DataFrame) -> Column:
    """128 bits of a row's values; equal rows have equal names."""
    return F.struct(F.xxhash64(*docs.columns).alias("a"), F.xxhash64(F.lit(SEED), *docs.columns).alias("b"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row per whole pass, and one with the selected blocks if there are any.

    Decisions are made on names of rows; texts are shuffled once, to meet theirs. Equal rows share a text there.
    """
    if "source" not in docs.columns:
        docs = docs.withColumn("source", F.lit(None).cast("string"))
    cols, name = docs.columns, row_name(docs)
    work = Work(docs.sparkSession, "mixed")
    taken = mix(docs.select(name.alias("name"), "doc_id", "source", "text")).filter("taken > 0").drop("doc_id", "source")
    m = work.save(taken, "taken").join(docs.select(name.alias("name"), F.struct(*cols).alias("row")).groupBy("name").agg(F.first("row").alias("row")), "name")

    @F.pandas_udf("string")
    def cut(text: pd.Series, begin: pd.Series, chosen: pd.Series, blocks: pd.Series, step: pd.Series, shift: pd.Series) -> pd.Series:
        return pd.Series([selected_text(t, *map(int, x)) if t else "" for t, *x in zip(text, begin, chosen, blocks, step, shift, strict=True)], dtype=object)

    partly = F.col("taken") > F.col("passes") * F.col("size")
    m = m.withColumn("cut", cut(F.when(partly, F.col("row.text")), "begin", "chosen", "blocks", "step", "shift"))
    copies = F.sequence(F.when(partly, 0).otherwise(1).cast("bigint"), "passes")
    copies = F.when(partly | (F.col("passes") > 0), copies).otherwise(F.array().cast("array<bigint>"))
    m = m.withColumn("copy", F.explode(copies))
    text = F.when(F.col("copy") == 0, F.col("cut")).otherwise(F.col("row.text"))
    out = {c: F.col("row")[c] for c in cols} | {"text": text}
    if "n_chars" in cols:
        out["n_chars"] = F.when(F.col("copy") == 0, F.length("cut")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return m.select(*[out[c].alias(c) for c in cols])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
