"""Document fingerprints: one-permutation MinHash with densified bins and packed low-order bits.

DataFrame functions only. A text's shingles are its runs of SHINGLE words (the whole sequence if it has fewer). Each
shingle is hashed once; the top bits choose one of BINS bins, and a bin keeps its least value. An empty bin borrows from
the non-empty bin that comes first in the empty bin's own pseudo-random order of bins: the draw that optimal
densification makes by repeated hashing, without an open-ended loop. A borrowed value is hashed with the number of the
bin, else all bins of a short text would agree with another's by chance at once. Each bin keeps BITS low-order bits, packed
into longs, written as BINS hexadecimal digits. ``likeness`` corrects the share of equal digits for chance matches.

``beside_successors`` pairs each document with the next one by falling doc_id, null ids last. The order is found on
narrow rows (id, -2**63 for null, two hashes of the text, length, fingerprint): one range partitioning, a look at the next row, and the first
rows of the partitions, one each, for the last ones. Texts are then shuffled once by id and hashes, and only the part that a
predecessor asks for is sent on, so nothing depends on how many documents a partition has.

A text without words (null, empty, white space) has the empty fingerprint, like only itself. Equal texts have equal
fingerprints, and very long ones are read whole. Rows of one id, null ids among them, are in falling order of their
texts' hashes; repeated rows follow each other. An empty table gives an empty one; extra columns are left out by the query
and kept by ``fingerprint``, where the added column replaces a clashing one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import Work
from .text import table, words

SHINGLE, BINS, BITS = 5, 128, 4
LOW = 56
PER_LONG = 64 // BITS
LONGS = BINS // PER_LONG
LEAST_ID = -(2**63)


def _long(v: int) -> Column:
    return F.lit(v).cast("bigint")


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`, an array of LONGS longs; empty for a text without words. Each step is a column of its own, so it runs once."""
    h, arr, firsts, full, dense = (f"_{out}_{k}" for k in ("h", "arr", "firsts", "full", "dense"))
    df = df.withColumn(h, F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    n = F.size(h)
    starts = F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))
    one = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]), 1))
    ends = F.transform(F.sequence(_long(0), _long(BINS - 1)), lambda b: F.shiftleft(b, LOW).bitwiseOR(_long((1 << LOW) - 1)))
    df = df.withColumn(arr, F.sort_array(F.concat(one, ends)))
    df = df.withColumn(firsts, F.filter(arr, lambda x, i: (i == 0) | (F.shiftright(x, LOW) != F.shiftright(F.get(arr, i - 1), LOW))))
    mask = _long((1 << LOW) - 1)
    df = df.withColumn(full, F.filter(firsts, lambda x: x.bitwiseAND(mask) != mask))
    low = _long((1 << BITS) - 1)
    high = _long(-(1 << BITS))

    def fill(x: Column, j: Column) -> Column:
        draw = F.array_min(F.transform(full, lambda y: F.xxhash64(j, F.shiftright(y, LOW)).bitwiseAND(high).bitwiseOR(F.xxhash64(y, j).bitwiseAND(low))))
        return F.when(x.bitwiseAND(mask) != mask, x.bitwiseAND(low)).otherwise(draw.bitwiseAND(low))

    df = df.withColumn(dense, F.transform(firsts, fill))
    packed = [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.get(dense, F.lit(k * PER_LONG + j)), 64 - BITS * (j + 1)) for j in range(PER_LONG)]) for k in range(LONGS)]
    return df.withColumn(out, F.when(n > 0, F.array(*packed)).otherwise(F.array().cast("array<bigint>"))).drop(h, arr, firsts, full, dense)


def as_hex(fp: str) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity, 0 to 1: (equal share - chance) / (1 - chance), not below 0."""
    ones = sum(1 << (BITS * k) for k in range(PER_LONG))

    def unequal(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        shift = 1
        while shift < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        return F.bit_count(x.bitwiseAND(_long(ones)))

    off = reduce(lambda x, y: x + y, [unequal(k) for k in range(LONGS)])
    chance = 2.0**-BITS
    est = F.greatest((1 - off / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(est)


KEY = ["key", "h1", "h2"]


def in_order(prints: DataFrame, work: Work) -> DataFrame:
    """Distinct KEY rows of prints (KEY, n, fp) with m, their number of rows, and next, the row that follows (the first
    after the last)."""
    groups = prints.groupBy(*KEY).agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.count("*").alias("m"))
    falling = [F.col(c).desc() for c in KEY]
    groups = work.save(groups.repartitionByRange(*falling).sortWithinPartitions(*falling).withColumn("pid", F.spark_partition_id()), "order")
    row = F.struct(*KEY, "fp")
    tops = groups.groupBy("pid").agg(F.max(row).alias("top"))
    whole = Window.orderBy("pid")
    beyond = F.coalesce(F.lead("top").over(whole), F.first("top").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tops = work.save(tops.select("pid", beyond.alias("beyond")), "tops")
    after = F.lead(row).over(Window.partitionBy("pid").orderBy(*falling))
    return work.save(groups.withColumn("after", after).join(tops, "pid").select(*KEY, "n", "m", "fp", F.coalesce("after", "beyond").alias("next")), "next")


def beside_successors(docs: DataFrame) -> DataFrame:
    """doc_id, text, n, fp, next_fp and head (the first floor(n / 2) code points of the next document) of docs (doc_id, text)."""
    work = Work(docs.sparkSession, "prints")
    key = F.coalesce(F.col("doc_id").cast("bigint"), _long(LEAST_ID)).alias("key")
    text = F.coalesce("text", F.lit(""))
    # Both joins take the same four columns, so that they share one exchange of the texts.
    d = docs.select(key, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    prints = add_fingerprint(d.withColumn("n", F.length("text")), "text", "fp").select(*KEY, "n", "fp")
    order = in_order(work.save(prints, "prints"), work)
    work.drop("prints")
    asked = order.select(*[F.col("next")[c].alias(c) for c in KEY], *[F.col(c).alias(f"by_{c}") for c in KEY], F.expr("int(n div 2)").alias("need"))
    heads = d.join(asked, KEY).groupBy(*[f"by_{c}" for c in KEY]).agg(F.first(F.substring("text", F.lit(1), F.col("need"))).alias("head"))
    heads = heads.select(*[F.col(f"by_{c}").alias(c) for c in KEY], "head")
    own = d.join(order, KEY).join(heads, KEY).withColumn("nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(*KEY)))
    last = F.col("nth") == F.col("m")
    head = F.when(last, F.col("head")).otherwise(F.substring("text", F.lit(1), F.expr("int(n div 2)")))
    doc_id = F.when(F.col("key") != _long(LEAST_ID), F.col("key")).alias("doc_id")
    return own.select(doc_id, "text", "n", "fp", F.when(last, F.col("next.fp")).otherwise(F.col("fp")).alias("next_fp"), head.alias("head"))


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the hexadecimal fingerprint of a text column."""
    return add_fingerprint(docs.drop(out), text, "_fp").withColumn(out, as_hex("_fp")).drop("_fp")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = beside_successors(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edited = F.concat(F.substring("text", F.lit(1), F.expr("int(n - n div 2)")), "head")
    d = add_fingerprint(d.withColumn("edited", edited).drop("text", "head"), "edited", "edited_fp")
    return d.select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex("fp").alias("fingerprint"),
        as_hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
