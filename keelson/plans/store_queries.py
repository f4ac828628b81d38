"""Registered queries that go through a stored engine: bulk writes, capacity, replay, typed values, exports and merges.

Each builds a store of its own in the work folder from whole fixture tables and reads it back. Rows come in two batches,
even event ids before odd ones, so the order of writing differs from that of the ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.codec import PackedStruct
from ..operators import versions as V
from ..profiles import FLASH, Profile
from ..session import work_dir
from ..sources import legacy
from ..sources.store import Engine
from .queries import HISTORY, KV_SQL, LE2, kv_versions, table

#: A ring of 32 slots and room for all rows.
ROOM = replace(FLASH.with_ring(5, HISTORY), max_entries=2**40)
SMALL = replace(ROOM, max_entries=300)
READING = PackedStruct([("seq", "u32"), ("value", "f64"), ("code", "u16")])


def engine(s: SparkSession, profile: Profile = ROOM, **options) -> Engine:
    return Engine(s, f"{work_dir(s)}/engine-{uuid.uuid4().hex}", profile, **options)


def kv_rows(s: SparkSession, d: str) -> DataFrame:
    """Batch rows with payload props, emptied where value < 10."""
    payload = F.encode(F.when(F.col("value") < 10, "").otherwise(F.col("props")), "UTF-8")
    return kv_versions(s, d).select("key", "seq", F.col("seq").alias("ts"), "tombstone", payload.alias("payload"))


def log_rows(s: SparkSession, d: str) -> DataFrame:
    """Appends of every event, ids out of bounds included; error events have no payload."""
    payload = F.when(F.col("event_type") != "error", F.encode("event_type", "UTF-8"))
    return table(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_id").alias("ts"), payload.alias("payload"))


def halves(rows: DataFrame) -> list[DataFrame]:
    return [rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")]


def filled(s: SparkSession, d: str, kv: bool = True, logs: bool = False, **options) -> Engine:
    e = engine(s, **options)
    for b in halves(kv_rows(s, d)) if kv else []:
        e.write_batch(b)
    for b in halves(log_rows(s, d)) if logs else []:
        e.write_logs(b)
    return e


def text(c: Column) -> Column:
    return F.decode(c, "UTF-8")


def store_kv(s, d):
    """Two batches, a merge, and a reader that opens the store anew and caches it."""
    e = filled(s, d)
    e.compact()
    again = Engine(s, e.store.root, ROOM, cache=True)
    return again.export_kv().select(F.col("key").cast("int").alias("key"), text(F.col("payload")).alias("payload"))


def store_rejects(s, d):
    """What a batch with keys and sizes on both sides of the bounds returns."""
    docs = table(s, d, "documents")
    rows = docs.select((3 * F.col("doc_id") - 30).alias("key"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("ts"), F.lit(False).alias("tombstone"), F.encode(F.repeat("text", F.lit(40)), "UTF-8").alias("payload"))
    return engine(s).write_batch(rows).select("key", "status")


def store_full(s, d):
    """Puts that a store of 300 entries takes no more when its policy is to reject."""
    return engine(s, replace(SMALL, on_full="reject")).write_batch(kv_rows(s, d)).select("key", "seq", "status")


def store_evicts(s, d):
    """Keys that a store of 300 entries holds when its policy is to evict the oldest."""
    e = engine(s, SMALL)
    e.write_batch(kv_rows(s, d))
    return V.latest_live(e.kv()).select(F.col("key").cast("int").alias("key"), "ts")


def store_logs(s, d):
    return filled(s, d, kv=False, logs=True).export_logs().select(F.col("id").cast("int").alias("id"), "slot", text(F.col("payload")).alias("payload"))


def store_log_rejects(s, d):
    return engine(s).write_logs(log_rows(s, d)).select("id", "seq")


def store_log_history(s, d):
    """Live slots that a merge leaves of each log."""
    e = filled(s, d, kv=False, logs=True)
    e.compact()
    e.store.vacuum()
    return e.logs().select(F.col("id").cast("int").alias("id"), "slot", F.col("ts").alias("event"))


def store_log_delete(s, d):
    """A deleted log and the slot of the append after it."""
    e = filled(s, d, kv=False, logs=True)
    e.delete_log(7)
    e.put_log(7, b"next")
    return V.log_total(e.logs()).select(F.col("id").cast("int").alias("id"), "total")


def store_structs(s, d):
    """Typed values of both namespaces, packed, stored and unpacked."""
    ev = table(s, d, "events").withColumn("packed", READING.encode(F.col("event_id"), F.col("value"), F.col("event_id") % 977))
    e = engine(s)
    e.write_batch(ev.select((F.col("event_id") % 512).cast("int").alias("key"), F.col("event_id").alias("seq"), F.col("event_id").alias("ts"), F.lit(False).alias("tombstone"), F.col("packed").alias("payload")))
    e.write_logs(ev.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_id").alias("ts"), F.col("packed").alias("payload")))
    kv = V.latest_live(e.kv()).select(F.lit("kv").alias("ns"), F.col("key").alias("id"), READING.decode(F.col("payload")).alias("r"))
    logs = V.log_latest(e.logs()).select(F.lit("log").alias("ns"), "id", READING.decode(F.col("payload")).alias("r"))
    return kv.unionByName(logs).select("ns", "id", "r.seq", "r.value", "r.code")


def store_strings(s, d):
    """Strings with their NUL, read back under the cap."""
    docs = table(s, d, "documents")
    e = engine(s, replace(ROOM, kv_keys=2**40))
    e.write_batch(docs.select(F.col("doc_id").alias("key"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("ts"), F.lit(False).alias("tombstone"), K.nul_terminated(F.col("text")).alias("payload")))
    return V.latest_live(e.kv()).select("key", V.capped_string(K.decode_string(F.col("payload")), ROOM.string_cap).alias("value"))


def wal_replay(s, d):
    """Write-ahead files of all versions in the order of seq, replayed into a store."""
    s.dataSource.register(legacy.WalSource)
    e = engine(s)
    path = f"{e.store.root}-wal"
    kv_rows(s, d).repartitionByRange("seq").sortWithinPartitions("seq").select(F.col("key").cast("bigint").alias("key"), "tombstone", "payload").write.format("ring_wal").mode("append").save(path)
    e.import_wal(path)
    return e.export_kv().select(F.col("key").cast("int").alias("key"), text(F.col("payload")).alias("payload"))


def sst_import(s, d):
    """Sorted-table files of both namespaces, loaded into a store: the newer time stamp wins."""
    s.dataSource.register(legacy.SstSource)
    e = engine(s)
    path = f"{e.store.root}-sst"
    kv = kv_rows(s, d).select(F.col("key").cast("bigint").alias("vkey"), "ts", "tombstone", "payload")
    slots = V.assign_slots(log_rows(s, d).filter(F.col("id") < ROOM.log_ids), ROOM.slots, ["seq"])
    logs = slots.select(K.pack_vkey(F.col("id"), F.col("slot"), ROOM).alias("vkey"), "ts", F.col("payload").isNull().alias("tombstone"), "payload")
    for prefix, rows in (("lv0", kv), ("log_lv0", logs)):
        rows.repartition("vkey").sortWithinPartitions("vkey").write.format("ring_sst").option("prefix", prefix).mode("append").save(path)
    e.import_sst(path)
    live = V.latest_live(e.store.read(), ["ns", "id", "slot"])
    return live.select("ns", "id", "slot", text(F.col("payload")).alias("payload"))


def _stream(s, e: Engine, logs: bool) -> DataFrame:
    path = f"{e.store.root}.frames"
    e.export_stream(path, logs=logs)
    return s.read.format("binaryFile").load(path).select(F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


def kv_byte_stream(s, d):
    """Length and SHA-256 of the exported bytes, which fixes the order of frames."""
    return _stream(s, filled(s, d), False)


def log_byte_stream(s, d):
    return _stream(s, filled(s, d, kv=False, logs=True), True)


def store_audit(s, d):
    """Entries and tombstones of the levels after a merge of the even half and a later write of the odd one."""
    e = engine(s)
    even, odd = halves(kv_rows(s, d))
    e.write_batch(even)
    e.compact()
    e.write_batch(odd)
    return e.audit().select("ns", "lvl", "n_entries", "n_tombstones", "n_bytes")


def store_scheduler(s, d):
    """Levels that the scheduler merges while four batches come in, and the rows that are live then."""
    e, merged = engine(s), []
    for k in range(4):
        e.write_batch(kv_rows(s, d).filter(F.col("seq") % 4 == k))
        merged.append(e.tick())
    n = sum(x == 0 for x in merged)
    return V.live_count(e.kv()).select(F.lit(n).alias("n_merges"), "n_live")


#: Versions with their payload; w is the order of writing.
_KV = f"(select key, seq, case when seq % 2 = 0 then seq else 1000000000000 + seq end as w, tombstone or value < 10 or octet_length(encode(props)) = 0 as gone, props from {KV_SQL})"
_LOG = """(select id, event, n, cast(n % 32 as int) as slot, payload from (select cast(user_id as int) as id, event_id as event,
 row_number() over (partition by user_id order by event_id % 2, event_id) - 1 as n, case when event_type <> 'error' then event_type end as payload from events where user_id between 0 and 63))"""
_KV_LIVE = f"(select key, arg_max(props, w) as payload from {_KV} group by key having not arg_max(gone, w))"
_LOG_LIVE = f"(select id, slot, max(n) as n, arg_max_null(event, n) as event, arg_max_null(payload, n) as payload from {_LOG} group by id, slot having arg_max_null(payload, n) is not null)"
_BYTES = "octet_length(encode(payload))"
_KV_FRAME = f"{LE2.format(x='key')} || {LE2.format(x=_BYTES)} || hex(encode(payload))"
_LOG_FRAME = f"{LE2.format(x='id')} || {LE2.format(x='slot')} || {LE2.format(x=_BYTES)} || hex(encode(payload))"
_STREAM = "select cast(length(h) // 2 as bigint) as n_bytes, sha256(unhex(h)) as digest from (select string_agg({frame}, '' order by {order}) as h from {rows})"
_SIZE = "case when value < 10 then 0 else octet_length(encode(props)) end + 13"
_LEVELS = f"""(select 'kv' as ns, 1 as lvl, false as gone, arg_max(b, seq) as b from (select key, seq, {_SIZE} as b, tombstone or value < 10 as gone from {KV_SQL} where seq % 2 = 0) group by key having not arg_max(gone, seq)
 union all select 'kv', 0, tombstone or value < 10, {_SIZE} from {KV_SQL} where seq % 2 = 1)"""

ORACLES: dict[str, str] = {
    "store_kv": f"select key, payload from {_KV_LIVE}",
    "store_rejects": "select key, status from (select 3 * doc_id - 30 as key, case when 3 * doc_id < 30 or 3 * doc_id >= 2078 then 'bad_key' when octet_length(encode(text)) * 40 > 65535 then 'bad_size' else 'ok' end as status from documents) where status <> 'ok'",
    "store_full": f"with p as (select key, min(seq) as f from {_KV} where not gone group by key) select key, seq, 'full' as status from {_KV} where not gone and seq >= (select f from p order by f limit 1 offset 300)",
    "store_evicts": f"select key, max(seq) as ts from {_KV} group by key having not arg_max(gone, seq) order by ts desc limit 300",
    "store_logs": f"select id, slot, payload from {_LOG_LIVE}",
    "store_log_rejects": "select user_id as id, event_id as seq from events where user_id is null or user_id < 0 or user_id > 63",
    "store_log_history": f"select id, slot, event from {_LOG_LIVE} qualify row_number() over (partition by id order by n desc) <= 16",
    "store_log_delete": f"select id, count(*) as total from {_LOG_LIVE} where id <> 7 group by id union all select 7, 1",
    "store_structs": "select 'kv' as ns, event_id % 512 as id, max(event_id) as seq, arg_max(value, event_id) as value, cast(max(event_id) % 977 as int) as code from events group by event_id % 512 union all select 'log', user_id, max(event_id), arg_max(value, event_id), cast(max(event_id) % 977 as int) from events where user_id between 0 and 63 group by user_id",
    "store_strings": "select doc_id as key, case when octet_length(encode(text)) + 1 <= 128 then text else '' end as value from documents where octet_length(encode(text)) + 1 <= 65535",
    "wal_replay": f"select key, arg_max(props, seq) as payload from {_KV} group by key having not arg_max(gone, seq)",
    "sst_import": f"""select 'kv' as ns, cast(key as bigint) as id, cast(null as int) as slot, arg_max(props, seq) as payload from {_KV} group by key having not arg_max(gone, seq)
 union all select 'log', id, slot, arg_max_null(payload, event) from (select user_id as id, event_id as event, cast((row_number() over (partition by user_id order by event_id) - 1) % 32 as int) as slot, case when event_type <> 'error' then event_type end as payload from events where user_id between 0 and 63) group by id, slot having arg_max_null(payload, event) is not null""",
    "kv_byte_stream": _STREAM.format(frame=_KV_FRAME, order="key", rows=_KV_LIVE),
    "log_byte_stream": _STREAM.format(frame=_LOG_FRAME, order="id, slot", rows=_LOG_LIVE),
    "store_audit": f"select ns, lvl, count(*) as n_entries, cast(sum(gone::int) as bigint) as n_tombstones, cast(sum(b) as bigint) as n_bytes from {_LEVELS} group by rollup (ns, lvl)",
    "store_scheduler": f"select 2 as n_merges, count(*) as n_live from (select key from (select key, seq % 4 as part, seq, gone from {_KV}) group by key having not arg_max(gone, part * 1000000000000 + seq))",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        store_kv, store_rejects, store_full, store_evicts, store_logs, store_log_rejects, store_log_history, store_log_delete, store_structs,
        store_strings, wal_replay, sst_import, kv_byte_stream, log_byte_stream, store_audit, store_scheduler,
    )
}
