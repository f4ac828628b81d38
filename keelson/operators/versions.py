"""Version resolution, reads, deletes, retention, eviction and audit.

Every operator takes an append-only version table: the key columns, ``seq`` (the only version order),
``ts``, ``tombstone`` and payload columns. A pick always comes before the tombstone filter, so a deleted
key never falls back to an older value. Reads of one key push their filter to the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KV = ["key"]
RING = ["id", "slot"]


def latest(v: DataFrame, keys: Sequence[str] = KV, order: str = "seq") -> DataFrame:
    """Newest version of each key, tombstones included. One shuffle with map-side combine."""
    rest = [c for c in v.columns if c not in keys]
    picked = v.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v"))
    return picked.select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


def live(picked: DataFrame) -> DataFrame:
    return picked.filter(~F.col("tombstone"))


def latest_live(v: DataFrame, keys: Sequence[str] = KV) -> DataFrame:
    """Full scan of live values: each key once, newest version, deleted keys left out."""
    return live(latest(v, keys))


def get(v: DataFrame, key: int | Sequence[int], col: str = "key") -> DataFrame:
    """Lookup of one key or several; the key filter reaches the scan."""
    wanted = F.col(col).isin(*key) if isinstance(key, (list, tuple)) else F.col(col) == F.lit(key)
    return latest_live(v.filter(wanted), [col])


def export(v: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Live rows whose payload isn't empty. The order is free."""
    return latest_live(v, keys).filter(F.octet_length(F.col(payload)) > 0)


def capped_string(c: Column, cap: int) -> Column:
    """The string if it and its NUL fit into cap bytes, else the empty string; absent is empty too."""
    return F.when(F.octet_length(c) + 1 <= cap, c).otherwise(F.lit(""))


def guard_kv(v: DataFrame, key_limit: int, payload: str | None = None, payload_limit: int = 65535) -> DataFrame:
    """Adds status: ok, bad_key or bad_size."""
    bad_key = F.col("key").isNull() | (F.col("key") < 0) | (F.col("key") >= key_limit)
    bad_size = F.octet_length(F.col(payload)) > payload_limit if payload else F.lit(False)
    return v.withColumn("status", F.when(bad_key, "bad_key").when(bad_size, "bad_size").otherwise("ok"))


def empty_is_tombstone(v: DataFrame, payload: str) -> DataFrame:
    """A write of no bytes deletes, on every path."""
    return v.withColumn("tombstone", F.col("tombstone") | (F.coalesce(F.octet_length(F.col(payload)), F.lit(0)) == 0))


# ring logs


def assign_slots(appends: DataFrame, slots: int, order: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Adds n (appends to the id before this one) and slot = n mod slots.

    counts (id, n_before) continues earlier batches; it has a row per id, so the join is on the window's own key.
    """
    w = Window.partitionBy("id").orderBy(*order)
    out = appends.withColumn("n", F.row_number().over(w).cast("bigint") - 1)
    if counts is not None:
        out = out.join(counts, "id", "left").withColumn("n", F.col("n") + F.coalesce("n_before", F.lit(0))).drop("n_before")
    return out.withColumn("slot", F.pmod("n", F.lit(slots)).cast("int"))


def log_latest(v: DataFrame) -> DataFrame:
    """Newest version of each id; nothing for an id whose newest version is a tombstone."""
    return live(latest(v, ["id"]))


def log_latest_live(v: DataFrame) -> DataFrame:
    """Newest slot of each id that is still live."""
    return latest(latest_live(v, RING), ["id"])


def log_slot(v: DataFrame, log_id: int, slot: int, slots: int) -> DataFrame:
    hit = v.filter((F.col("id") == log_id) & (F.col("slot") == slot) & F.lit(0 <= slot < slots))
    return latest_live(hit, RING)


def log_range(v: DataFrame, start: int, end: int, slots: int, log_id: int | None = None, chronological: bool = False) -> DataFrame:
    """Live slots in [start, end], clipped to the ring; an inverted range is empty. Sorted by slot, or by seq."""
    hit = v.filter(F.col("slot").between(max(start, 0), min(end, slots - 1)))
    if log_id is not None:
        hit = hit.filter(F.col("id") == log_id)
    return latest_live(hit, RING).orderBy("id", "seq" if chronological else "slot")


def log_total(v: DataFrame) -> DataFrame:
    """Live slots of each id."""
    return latest_live(v.select("id", "slot", "seq", "tombstone"), RING).groupBy("id").agg(F.count("*").alias("total"))


def log_delete(v: DataFrame, log_id: int, seq_from: int) -> DataFrame:
    """Tombstones for every live slot of an id, numbered from seq_from by slot; none when nothing lives."""
    gone = latest_live(v.filter(F.col("id") == log_id), RING)
    return gone.withColumns({"seq": F.lit(seq_from).cast("bigint") + F.col("slot"), "tombstone": F.lit(True)}).select(*v.columns)


def log_retention(v: DataFrame, history: int) -> DataFrame:
    """Newest `history` live slots of each id."""
    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    return latest_live(v, RING).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= history).drop("_r")


# maintenance


def total_versions(v: DataFrame) -> DataFrame:
    return v.filter(~F.col("tombstone")).agg(F.count("*").alias("n_versions"))


def live_count(v: DataFrame, keys: Sequence[str] = KV) -> DataFrame:
    return latest_live(v.select(*keys, "seq", "tombstone"), keys).agg(F.count("*").alias("n_live"))


def evict_oldest(v: DataFrame, k: int, keys: Sequence[str] = KV, namespaces: bool = False) -> DataFrame:
    """The k oldest live rows: by ts, then KV before log, then key. Plans as a top-k, without a full sort."""
    order = ["ts", *(["ns"] if namespaces else []), *keys]
    return latest_live(v, keys).orderBy(*order).limit(k)


def tombstones_for(victims: DataFrame, seq_from: int, keys: Sequence[str] = KV) -> DataFrame:
    """Tombstone rows for evicted keys, numbered above seq_from in key order."""
    w = Window.orderBy(*keys)
    return victims.withColumns({"seq": F.lit(seq_from).cast("bigint") + F.row_number().over(w), "tombstone": F.lit(True)})


def compact(v: DataFrame, keys: Sequence[str] = KV, full: bool = False) -> DataFrame:
    """One version per key. A partial merge keeps tombstones; a full one drops them, as nothing older remains."""
    picked = latest(v, keys)
    return live(picked) if full else picked


def shadowed(older: DataFrame, newer: DataFrame, keys: Sequence[str] = KV) -> DataFrame:
    """Older rows whose key a newer generation does not write."""
    return older.join(newer.select(*keys).distinct(), list(keys), "left_anti")


def level_audit(v: DataFrame) -> DataFrame:
    """Per namespace and level: files, entries, tombstones, bytes; totals by rollup where ns or level is null."""
    return v.rollup("ns", "lvl").agg(
        F.countDistinct("file_id").alias("n_files"),
        F.count("*").alias("n_entries"),
        F.sum(F.col("tombstone").cast("bigint")).alias("n_tombstones"),
        F.sum("bytes").alias("n_bytes"),
    )


def gauges(files: DataFrame, capacity: int) -> DataFrame:
    """Used and free bytes, and whether storage is nine tenths full."""
    used = F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint")
    return files.agg(used.alias("used")).select(
        F.lit(capacity).cast("bigint").alias("total"), "used", (F.lit(capacity) - F.col("used")).cast("bigint").alias("free"), (F.col("used") >= capacity * 9 // 10).alias("nearly_full")
    )
