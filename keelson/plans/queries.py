"""The engine's own queries over the fixture tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import versions as V
from ..profiles import FLASH

RING, HISTORY, KEY_SPACE, L0_ROWS = 32, 16, 512, 512
OFFSET = FLASH.vkey_offset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv_versions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % KEY_SPACE).cast("int").alias("key"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") == "error").alias("tombstone"), "event_type", "value", "props")


def kv_orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("tombstone"), "o_totalprice", "o_orderpriority")


def log_appends(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("user_id") < FLASH.log_ids)
    return e.select(F.col("user_id").cast("int").alias("id"), "event_id", "ts", F.lit(False).alias("tombstone"), "event_type", "value")


def log_versions(spark: SparkSession, d: str) -> DataFrame:
    return V.assign_slots(log_appends(spark, d), RING, ["ts", "event_id"]).withColumnRenamed("n", "seq").drop("event_id")


KV_SQL = "(select cast(event_id % 512 as int) as key, event_id as seq, ts, event_type = 'error' as tombstone, event_type, value, props from events)"
ORD_SQL = "(select o_custkey as key, o_orderkey as seq, o_orderdate as ts, o_orderstatus = 'F' as tombstone, o_totalprice, o_orderpriority from orders)"
LOG_SQL = """(select id, seq, cast(seq % 32 as int) as slot, ts, false as tombstone, event_type, value from
 (select cast(user_id as int) as id, row_number() over (partition by user_id order by ts, event_id) - 1 as seq, ts, event_type, value from events where user_id < 64))"""
PICK_LOG = f"(select id, slot, max(seq) as seq, arg_max_null(ts, seq) as ts, arg_max_null(value, seq) as value, arg_max_null(event_type, seq) as event_type from {LOG_SQL} group by id, slot having not arg_max_null(tombstone, seq))"
KV_LIVE = f"(select key, max(seq) as seq, arg_max_null(ts, seq) as ts, arg_max_null(event_type, seq) as event_type, arg_max_null(value, seq) as value, arg_max_null(props, seq) as props from {KV_SQL} {{where}} group by key having not arg_max_null(tombstone, seq))"


def _leveled(v: DataFrame) -> DataFrame:
    """Synthetic generations of the KV table: files of 512 rows, the older half in level 1."""
    return v.withColumns({"file_id": F.expr(f"seq div {L0_ROWS}"), "lvl": F.expr(f"cast(seq div {L0_ROWS} % 2 as int)"), "ns": F.lit("kv"), "bytes": (F.octet_length("props") + 13).cast("bigint")})


def kv_latest_live(s, d):
    return V.latest_live(kv_versions(s, d)).select("key", "event_type", "value")


def kv_get(s, d):
    return V.get(kv_versions(s, d), 42).select("key", "seq", "value")


def kv_multi_get(s, d):
    return V.get(kv_versions(s, d), [1, 7, 42, 511]).select("key", "seq", "value")


def kv_get_string(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), V.capped_string(F.col("text"), FLASH.string_cap).alias("value"))
    return docs


def kv_export(s, d):
    """Payloads of low values are empty; such rows live but aren't exported."""
    v = kv_versions(s, d).withColumn("props", F.when(F.col("value") < 100, "").otherwise(F.col("props")))
    return V.export(v, ["key"], "props").select("key", "props", F.octet_length("props").alias("len"))


def kv_orders_live(s, d):
    return V.latest_live(kv_orders(s, d)).select("key", "seq", "o_totalprice", "o_orderpriority")


def kv_total_versions(s, d):
    return V.total_versions(kv_versions(s, d))


def kv_live_count(s, d):
    return V.live_count(kv_versions(s, d))


def kv_delete(s, d):
    v = kv_versions(s, d).select("key", "seq", "tombstone", "value")
    gone = v.select("key").distinct().filter("key % 3 = 0").select("key", (F.lit(100000000) + F.col("key")).alias("seq"), F.lit(True).alias("tombstone"), F.lit(None).cast("double").alias("value"))
    return V.latest_live(v.unionByName(gone)).select("key", "value")


def kv_empty_put(s, d):
    """Payload emptied where value < 100: such a write deletes."""
    v = kv_versions(s, d).select("key", "seq", "tombstone", F.when(F.col("value") < 100, "").otherwise(F.col("props")).alias("payload"))
    return V.latest_live(V.empty_is_tombstone(v, "payload")).select("key", "payload")


def log_slots(s, d):
    return log_versions(s, d).select("id", "seq", "slot")


def log_latest(s, d):
    """Error events are tombstones: an id whose newest version is one has no value."""
    v = log_versions(s, d).withColumn("tombstone", F.col("event_type") == "error")
    return V.log_latest(v).select("id", "slot", "value")


def log_latest_live(s, d):
    """Newest live slot of each id when its error events are tombstones."""
    v = log_versions(s, d).withColumn("tombstone", F.col("event_type") == "error")
    return V.log_latest_live(v).select("id", "slot", "seq", "value")


def log_get_slot(s, d):
    return V.log_slot(log_versions(s, d), 7, 3, RING).select("id", "slot", "seq", "value")


def log_range(s, d):
    return V.log_range(log_versions(s, d), 8, 24, RING).select("id", "slot", "seq", "value")


def log_range_chronological(s, d):
    r = V.log_range(log_versions(s, d), 0, 99, RING, log_id=7, chronological=True)
    return r.select("id", "slot", "seq", "ts", "value")


def log_range_inverted(s, d):
    return V.log_range(log_versions(s, d), 24, 8, RING).select("id", "slot")


def log_total(s, d):
    return V.log_total(log_versions(s, d))


def log_delete(s, d):
    v = log_versions(s, d)
    return V.log_total(v.unionByName(V.log_delete(v, 7, 1000000)))


def log_delete_then_append(s, d):
    """After id 7 is deleted, its append count goes on: the next row takes slot count mod N."""
    v = log_versions(s, d)
    n = v.filter("id = 7").agg(F.count("*").alias("c"))
    more = n.select(F.lit(7).alias("id"), (F.col("c") % RING).cast("int").alias("slot"), (F.col("c") + 2000000).alias("seq"), F.lit(False).alias("tombstone"))
    v = v.unionByName(V.log_delete(v, 7, 1000000)).select("id", "slot", "seq", "tombstone")
    return V.latest_live(v.unionByName(more), V.RING).select("id", "slot", "seq")


def log_retention(s, d):
    return V.log_retention(log_versions(s, d), HISTORY).select("id", "slot", "seq", "value")


def evict_oldest(s, d):
    return V.evict_oldest(kv_versions(s, d), 20).select("key", "ts", "value")


def compact_equivalence(s, d):
    """Merge the two levels apart, union, merge again: the same rows as one pick."""
    v = _leveled(kv_versions(s, d)).select("lvl", "key", "seq", "tombstone", "value")
    return V.latest(V.latest(v, ["lvl", "key"]).drop("lvl")).select("key", "seq", "tombstone", "value")


def compact_full(s, d):
    return V.compact(kv_versions(s, d), full=True).select("key", "seq", "value")


def shadowed_keys(s, d):
    """Rows of level 1 that level 0 doesn't overwrite."""
    v = kv_orders(s, d)
    return V.shadowed(v.filter("seq % 2 = 1"), v.filter("seq % 2 = 0")).select("key", "seq", "o_totalprice")


def level_audit(s, d):
    return V.level_audit(_leveled(kv_versions(s, d)))


def storage_gauges(s, d):
    files = _leveled(kv_versions(s, d)).groupBy("file_id").agg(F.sum("bytes").alias("bytes"))
    return V.gauges(files, 1_000_000)


def vkey_pack(s, d):
    v = log_versions(s, d).select("id", "slot").distinct().withColumn("vkey", K.pack_vkey(F.col("id"), F.col("slot")))
    return v.select("vkey", "id", "slot", K.unpack_id(F.col("vkey")).alias("id_back"), K.unpack_slot(F.col("vkey")).alias("slot_back"))


def write_guards(s, d):
    """Keys on both sides of the bounds, payloads of repeated texts on both sides of the limit."""
    docs = table(s, d, "documents").select((3 * F.col("doc_id") - 30).alias("key"), F.repeat("text", F.lit(40)).alias("text"))
    return V.guard_kv(docs, FLASH.kv_keys, "text", FLASH.payload_limit).select("key", "status")


def log_guards(s, d):
    e = table(s, d, "events").select(F.when(F.col("user_id") < FLASH.log_ids, "ok").otherwise("bad_id").alias("status"))
    return e.groupBy("status").agg(F.count("*").alias("n"))


def _vkeys(s, d):
    kv = kv_versions(s, d).select(F.col("key").cast("bigint").alias("vkey"))
    return kv.unionAll(log_versions(s, d).select(K.pack_vkey(F.col("id"), F.col("slot")).alias("vkey")))


def namespace_split(s, d):
    is_log = K.is_log(F.col("vkey"))
    return _vkeys(s, d).agg(F.count_if(is_log).alias("n_log"), F.count_if(~is_log).alias("n_kv"))


def kv_wire_frames(s, d):
    v = V.export(kv_versions(s, d), ["key"], "props")
    return v.select("key", F.hex(K.kv_frame(F.col("key"), F.encode("props", "UTF-8"))).alias("frame"))


def log_wire_frames(s, d):
    v = V.latest_live(log_versions(s, d), V.RING)
    return v.select("id", "slot", F.hex(K.log_frame(F.col("id"), F.col("slot"), F.encode("event_type", "UTF-8"))).alias("frame"))


def wal_frames(s, d):
    v = kv_versions(s, d)
    return v.select("seq", F.hex(K.wal_frame(F.col("key"), F.encode("event_type", "UTF-8"), F.col("tombstone"))).alias("frame"))


LE2 = "printf('%02X%02X', {x} & 255, ({x} >> 8) & 255)"
#: Frames before their check, and CRC-32 bit by bit over the bytes of one (reflected polynomial 0xEDB88320).
_WAL = f"(select seq, {LE2.format(x='key')} || {LE2.format(x='octet_length(encode(event_type))')} || '0000' || hex(encode(event_type)) || case when tombstone then '01' else '00' end as h from {KV_SQL})"
_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
 lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda a, z: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end))"""
_AUDIT = f"select *, seq // 512 as file_id, cast(seq // 512 % 2 as int) as lvl, 'kv' as ns, cast(octet_length(encode(props)) + 13 as bigint) as bytes from {KV_SQL}"

ORACLES: dict[str, str] = {
    "kv_latest_live": f"select key, event_type, value from {KV_LIVE.format(where='')}",
    "kv_get": f"select key, seq, value from {KV_LIVE.format(where='where key = 42')}",
    "kv_multi_get": f"select key, seq, value from {KV_LIVE.format(where='where key in (1, 7, 42, 511)')}",
    "kv_get_string": "select doc_id as key, case when octet_length(encode(text)) + 1 <= 128 then text else '' end as value from documents",
    "kv_export": f"select key, props, cast(octet_length(encode(props)) as int) as len from (select key, case when value < 100 then '' else props end as props from {KV_LIVE.format(where='')}) where octet_length(encode(props)) > 0",
    "kv_orders_live": f"select key, max(seq) as seq, arg_max_null(o_totalprice, seq) as o_totalprice, arg_max_null(o_orderpriority, seq) as o_orderpriority from {ORD_SQL} group by key having not arg_max_null(tombstone, seq)",
    "kv_total_versions": f"select count(*) as n_versions from {KV_SQL} where not tombstone",
    "kv_live_count": f"select count(*) as n_live from {KV_LIVE.format(where='')}",
    "kv_delete": f"select key, value from {KV_LIVE.format(where='')} where key % 3 <> 0",
    "kv_empty_put": f"select key, arg_max_null(payload, seq) as payload from (select key, seq, tombstone, case when value < 100 then '' else props end as payload from {KV_SQL}) group by key having not arg_max_null(tombstone, seq) and octet_length(encode(arg_max_null(payload, seq))) > 0",
    "log_slots": f"select id, seq, slot from {LOG_SQL}",
    "log_latest": f"select id, arg_max_null(slot, seq) as slot, arg_max_null(value, seq) as value from {LOG_SQL} group by id having arg_max_null(event_type, seq) <> 'error'",
    "log_latest_live": f"select id, arg_max_null(slot, seq) as slot, max(seq) as seq, arg_max_null(value, seq) as value from (select id, slot, max(seq) as seq, arg_max_null(value, seq) as value from {LOG_SQL} group by id, slot having arg_max_null(event_type, seq) <> 'error') group by id",
    "log_get_slot": f"select id, slot, seq, value from {PICK_LOG} where id = 7 and slot = 3",
    "log_range": f"select id, slot, seq, value from {PICK_LOG} where slot between 8 and 24",
    "log_range_chronological": f"select id, slot, seq, ts, value from {PICK_LOG} where id = 7",
    "log_range_inverted": f"select id, slot from {PICK_LOG} where slot between 24 and 8",
    "log_total": f"select id, count(*) as total from {PICK_LOG} group by id",
    "log_delete": f"select id, count(*) as total from {PICK_LOG} where id <> 7 group by id",
    "log_delete_then_append": f"select id, slot, seq from {PICK_LOG} where id <> 7 union all select 7, cast(count(*) % 32 as int), count(*) + 2000000 from {LOG_SQL} where id = 7",
    "log_retention": f"select id, slot, seq, value from {PICK_LOG} qualify row_number() over (partition by id order by seq desc) <= 16",
    "evict_oldest": f"select key, ts, value from {KV_LIVE.format(where='')} order by ts, key limit 20",
    "compact_equivalence": f"select key, max(seq) as seq, arg_max_null(tombstone, seq) as tombstone, arg_max_null(value, seq) as value from {KV_SQL} group by key",
    "compact_full": f"select key, seq, value from {KV_LIVE.format(where='')}",
    "shadowed_keys": f"select key, seq, o_totalprice from {ORD_SQL} where seq % 2 = 1 and key not in (select key from {ORD_SQL} where seq % 2 = 0)",
    "level_audit": f"select ns, lvl, count(distinct file_id) as n_files, count(*) as n_entries, cast(sum(tombstone::int) as bigint) as n_tombstones, cast(sum(bytes) as bigint) as n_bytes from ({_AUDIT}) group by rollup (ns, lvl)",
    "storage_gauges": f"select cast(1000000 as bigint) as total, u as used, cast(1000000 - u as bigint) as free, u >= 900000 as nearly_full from (select cast(sum(bytes) as bigint) as u from ({_AUDIT}))",
    "vkey_pack": f"select {OFFSET} + id * 2048 + slot as vkey, id, slot, id as id_back, slot as slot_back from (select distinct id, slot from {LOG_SQL})",
    "write_guards": "select 3 * doc_id - 30 as key, case when 3 * doc_id < 30 or 3 * doc_id >= 2078 then 'bad_key' when octet_length(encode(text)) * 40 > 65535 then 'bad_size' else 'ok' end as status from documents",
    "log_guards": "select case when user_id < 64 then 'ok' else 'bad_id' end as status, count(*) as n from events group by 1",
    "namespace_split": f"select count(*) filter (where vkey >= {OFFSET}) as n_log, count(*) filter (where vkey < {OFFSET}) as n_kv from (select cast(key as bigint) as vkey from {KV_SQL} union all select {OFFSET} + id * 2048 + slot from {LOG_SQL})",
    "kv_wire_frames": f"select key, {LE2.format(x='key')} || {LE2.format(x='octet_length(encode(props))')} || hex(encode(props)) as frame from {KV_LIVE.format(where='')}",
    "log_wire_frames": f"select id, slot, {LE2.format(x='id')} || {LE2.format(x='slot')} || {LE2.format(x='octet_length(encode(event_type))')} || hex(encode(event_type)) as frame from {PICK_LOG}",
    "wal_frames": f"select seq, h || {LE2.format(x='c')} || {LE2.format(x='(c >> 16)')} as frame from (select seq, h, xor({_CRC}, 4294967295) as c from {_WAL})",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kv_latest_live, kv_get, kv_multi_get, kv_get_string, kv_export, kv_orders_live, kv_total_versions, kv_live_count, kv_delete, kv_empty_put,
        log_slots, log_latest, log_latest_live, log_get_slot, log_range, log_range_chronological, log_range_inverted, log_total, log_delete,
        log_delete_then_append, log_retention, evict_oldest, compact_equivalence, compact_full, shadowed_keys, level_audit, storage_gauges,
        vkey_pack, write_guards, log_guards, namespace_split, kv_wire_frames, log_wire_frames, wal_frames,
    )
}
