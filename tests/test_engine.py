"""The facade against a dictionary model, the codecs and binary formats, and the streams."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from keelson.functions import keys as K
from keelson.functions.codec import PackedStruct
from keelson.operators import versions as V
from keelson.profiles import FLASH, SD, compaction_level, memtable_limit
from keelson.sources import legacy
from keelson.sources.store import Engine
from keelson.streaming import ring


def test_profiles():
    assert FLASH.vkey_offset == 0xFFFDFFFF and SD.vkey_offset == 0xFFDFFFFF
    assert FLASH.slots == 2048 and SD.slots == 16384
    assert FLASH.with_string_cap(0) is FLASH and FLASH.with_string_cap(9).string_cap == 9
    assert compaction_level([7, 0, 0, 0]) == 0 and compaction_level([1, 4, 0, 0]) == 1 and compaction_level([6, 9], log=True) is None
    assert memtable_limit(0, 1024, 1.0, 0) == 8192 and memtable_limit(4096, 1024, 1.0, 0) == 2048


def test_engine_follows_a_model(spark, tmp_path):
    p = FLASH.with_ring(2, 3)
    e, kv, logs, counts, rnd = Engine(spark, str(tmp_path), p), {}, {}, {}, random.Random(5)
    for step in range(14):
        k, what = rnd.randrange(3), rnd.choice(["put", "put", "del", "log", "log", "log", "wipe", "empty"])
        body = f"{step}".encode()
        if what == "put":
            assert e.put(k, body)
            kv[k] = body
        elif what in ("del", "empty"):
            assert e.delete(k) if what == "del" else e.put(k, b"")
            kv.pop(k, None)
        elif what == "log":
            assert e.put_log(k, body)
            n = counts.get(k, 0)
            logs[k, n % 4], counts[k] = (step, body), n + 1
        else:
            assert e.delete_log(k)
            logs = {x: v for x, v in logs.items() if x[0] != k}
    def state():
        return {r.key: bytes(r.payload) for r in e.export_kv().collect()}, {(r.id, r.slot): bytes(r.payload) for r in e.export_logs().collect()}
    assert state() == (kv, {x: v[1] for x, v in logs.items()})
    for k in range(3):
        assert e.get(k) == kv.get(k) and e.total_log(k) == sum(x[0] == k for x in logs)
    e.compact()
    newest = {x: v for x, v in logs.items() if sum(y[0] == x[0] and w[0] > v[0] for y, w in logs.items()) < 3}
    assert state() == (kv, {x: v[1] for x, v in newest.items()})
    e.store.vacuum()
    assert state()[0] == kv and Engine(spark, str(tmp_path), p).store.manifest()["folders"]
    assert e.audit().filter("ns is null").first().n_entries == len(kv) + len(newest)
    assert e.gauges(10**9).first().used > 0
    e.format()
    assert state() == ({}, {}) and e.get(1) is None


def test_limits_and_strings(spark, tmp_path):
    e = Engine(spark, str(tmp_path), FLASH)
    assert not e.put(2048, b"x") and not e.put(1, b"x" * 65536) and not e.put_log(64, b"x")
    assert e.put(2047, b"x" * 65535) and e.put_string(50, "Grüße 🚀") and e.get_string(50) == "Grüße 🚀"
    assert e.put_string(51, "y" * 128) and e.get_string(51) == "" and e.get_string(52) == ""
    full = Engine(spark, str(tmp_path / "b"), FLASH.with_policy("reject").__class__(**{**FLASH.__dict__, "max_entries": 1, "on_full": "reject"}))
    assert full.put(1, b"a") and not full.put(2, b"b")
    evicts = Engine(spark, str(tmp_path / "c"), FLASH.__class__(**{**FLASH.__dict__, "max_entries": 1}))
    assert evicts.put(1, b"a") and evicts.put(2, b"b") and evicts.get(1) is None and evicts.get(2) == b"b"


def test_bulk_logs_and_cursor(spark, tmp_path):
    """150 rows for id 7 in a ring of 32: slots wrap, and the cursor walks slots in order."""
    e, c = Engine(spark, str(tmp_path), FLASH.with_ring(5, 32)), PackedStruct([("temp", "f32"), ("ticks", "u32"), ("token", "u16")])
    rows = spark.range(1, 151).select(F.lit(7).cast("bigint").alias("id"), F.col("id").alias("seq"), F.col("id").alias("ts"), c.encode(24.5 + 0.15 * F.col("id"), 1000 * F.col("id"), F.when(F.col("id") >= 130, 0xBBBB).otherwise(0xAAAA)).alias("payload"))
    rejects = e.write_logs(rows.unionByName(rows.limit(1).withColumn("id", F.lit(64).cast("bigint"))))
    assert rejects.count() == 1 and e.total_log(7) == 32 and e.total_log(8) == 0
    temp, ticks, token = struct.unpack("<fIH", e.get_log(7))
    assert abs(temp - 47.0) < 1e-3 and ticks == 150000 and token == 0xBBBB
    cur = e.log_iterator(7, 20, 99)
    seen = []
    while cur.next():
        seen.append(cur.slot)
    assert seen == list(range(20, 32)) and cur.slot == 0
    cur.close()
    assert not cur.next() and not e.log_iterator(7, 9, 3).next()
    assert e.get_log(7, 21) == e.get_log(7) and e.get_log(7, 32) is None
    got = V.log_latest(e.logs()).select(c.decode(F.col("payload")).alias("v")).first().v
    assert got.token == 0xBBBB


def test_write_batch_rejects(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    rows = spark.createDataFrame([(5000, 1, 1, False, bytearray(b"a")), (3, 2, 2, False, bytearray(b"b")), (3, 3, 3, False, bytearray(b"")), (4, 4, 4, False, None)], "key bigint, seq bigint, ts bigint, tombstone boolean, payload binary")
    assert [r.status for r in e.write_batch(rows).collect()] == ["bad_key"] and e.get(3) is None and e.get(4) is None


def test_bulk_logs_lose_no_row(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    rows = spark.createDataFrame([(7, 1, 1, bytearray(b"a")), (7, 2, 2, None), (None, 3, 3, bytearray(b"c")), (64, 4, 4, bytearray(b"d")), (8, 5, 5, bytearray(b"x" * 65536))], "id bigint, seq bigint, ts bigint, payload binary")
    assert sorted(r.seq for r in e.write_logs(rows).collect()) == [3, 4, 5]
    assert e.logs().count() == 2 and e.total_log(7) == 1 and e.get_log(7) is None and e.get_log(7, 0) == b"a"
    assert e.write_logs(rows.limit(1)).count() == 0 and e.get_log(7, 2) == b"a"


def test_bulk_capacity(spark, tmp_path):
    from dataclasses import replace

    kv = spark.createDataFrame([(k, k, k, False, bytearray(b"v")) for k in range(5)] + [(0, 9, 9, False, bytearray(b"w")), (1, 10, 10, True, None)], "key bigint, seq bigint, ts bigint, tombstone boolean, payload binary")
    e = Engine(spark, str(tmp_path / "a"), replace(FLASH, max_entries=3, on_full="reject"))
    assert sorted((r.key, r.status) for r in e.write_batch(kv).collect()) == [(0, "full"), (3, "full"), (4, "full")]
    assert [e.get(k) for k in range(5)] == [b"v", None, b"v", None, None]
    assert sorted(r.status for r in e.write_batch(kv.filter("key = 4")).collect()) == [] and e.get(4) == b"v"
    logs = spark.createDataFrame([(k % 2, k, k, bytearray(b"l")) for k in range(4)], "id bigint, seq bigint, ts bigint, payload binary")
    assert e.write_logs(logs).count() == 4 and e.logs().count() == 0
    e = Engine(spark, str(tmp_path / "b"), replace(FLASH, max_entries=3))
    assert e.write_batch(kv.filter("seq < 9")).count() == 0 and [e.get(k) for k in range(5)] == [None, None, b"v", b"v", b"v"]
    assert e.write_logs(logs.withColumn("ts", F.col("ts") + 90)).count() == 0 and e.logs().filter("not tombstone").count() == 4
    assert V.live_count(e.store.read(), ["ns", "id", "slot"]).first()[0] == 3
    small = Engine(spark, str(tmp_path / "c"), replace(FLASH, on_full="reject"), storage_bytes=100)
    assert small.put(1, b"a") and not small.put(2, b"b") and small.write_batch(kv).count() == 6 and small.delete(1)


def test_typed_calls_strings_and_files(spark, tmp_path):
    e, c = Engine(spark, str(tmp_path / "s")), PackedStruct([("ts", "u32"), ("t", "f32"), ("s", "u16")])
    assert e.put_struct(24, c, 5, 27.5, 0xAA55) and e.get_struct(24, c) == (5, 27.5, 0xAA55) and e.get_struct(25, c) is None
    assert e.put_log_struct(7, c, 1, 0.5, 2) and e.get_log_struct(7, c) == (1, 0.5, 2) and e.get_log_struct(8, c) is None
    assert e.put(50, b"text\0\0") and e.get_string(50) == "text\0"
    out = tmp_path / "frames.bin"
    n = e.export_stream(str(out))
    raw, at, seen = out.read_bytes(), 0, []
    while at < len(raw):
        key, size = struct.unpack_from("<HH", raw, at)
        seen.append((key, raw[at + 4 : at + 4 + size]))
        at += 4 + size
    assert n == len(raw) and seen == [(24, c.pack(5, 27.5, 0xAA55)), (50, b"text\0\0")]
    assert e.export_stream(str(out), logs=True) == 6 + 10 and out.read_bytes()[:6] == struct.pack("<HHH", 7, 0, 10)
    assert {r.n_entries for r in e.audit_files().collect()} == {1} and e.audit_files().count() == 3
    assert e.tick() == 0 and e.audit_files().filter("lvl = 1").count() >= 1 and e.tick() is None and e.get_struct(24, c)[0] == 5
    assert e.bytes_per_trigger(0, 1.0) == 8192


def test_import_of_files(spark, tmp_path):
    src = tmp_path / "f"
    src.mkdir()
    vkey = FLASH.vkey_offset + 7 * 2048
    (src / "lv0_1.sst").write_bytes(legacy.sst_bytes([(10, 1, False, b"old"), (24, 2, False, b"s"), (50, 3, False, b"gone")]))
    (src / "lv0_2.sst").write_bytes(legacy.sst_bytes([(10, 4, False, b"new"), (50, 5, True, b"")]))
    (src / "log_lv0_1.sst").write_bytes(legacy.sst_bytes([(vkey + k, 6 + k, False, bytes([k + 1])) for k in range(3)]))
    e = Engine(spark, str(tmp_path / "s"))
    e.import_sst(str(src))
    assert [e.get(k) for k in (10, 24, 50)] == [b"new", b"s", None] and e.total_log(7) == 3 and e.get_log(7, 2) == b"\3"
    assert e.put_log(7, b"next") and e.get_log(7, 3) == b"next"
    wal = tmp_path / "w"
    wal.mkdir()
    (wal / "wal_1.log").write_bytes(legacy.wal_bytes([(10, False, b"wal"), (24, True, b"")]) + b"\1")
    e.import_wal(str(wal))
    assert e.get(10) == b"wal" and e.get(24) is None


def test_wal_frames_query_reads_back(spark):
    from keelson.plans.queries import kv_versions, wal_frames

    d = "/root/testdata/sf0.01"
    want = {r.seq: (r.key, r.tombstone, r.event_type.encode()) for r in kv_versions(spark, d).collect()}
    got = {r.seq: list(legacy.wal_records(bytes.fromhex(r.frame))) for r in wal_frames(spark, d).collect()}
    assert got == {k: [v] for k, v in want.items()}


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from keelson.session import work_dir

    conf = lambda found: N(get=lambda k, d: found)
    with pytest.raises(ValueError, match="share"):
        work_dir(N(conf=conf(None), sparkContext=N(master="spark://h:1")))
    assert work_dir(N(conf=conf("hdfs:/x"), sparkContext=N(master="yarn"))) == "hdfs:/x"


def test_null_payload_stays_newest(spark):
    v = spark.createDataFrame([(1, 1, False, "a"), (1, 2, False, None), (2, 1, True, None)], "key int, seq bigint, tombstone boolean, payload string")
    assert [tuple(r) for r in V.latest_live(v).select("key", "payload").collect()] == [(1, None)]


def test_frames(spark, same):
    row = spark.createDataFrame([(300, 513, bytearray(b"hi"))], "a int, b int, p binary")
    f = row.select(K.kv_frame(F.col("a"), F.col("p")), K.log_frame(F.col("a"), F.col("b"), F.col("p")), K.wal_frame(F.col("a"), F.col("p"), F.lit(False)), K.decode_string(K.nul_terminated(F.lit("é🚀")))).first()
    assert bytes(f[0]) == struct.pack("<HH", 300, 2) + b"hi" and bytes(f[1]) == struct.pack("<HHH", 300, 513, 2) + b"hi"
    body = struct.pack("<HI", 300, 2) + b"hi\0"
    assert bytes(f[2]) == body + struct.pack("<I", zlib.crc32(body)) and f[3] == "é🚀"


def test_codec_rejects_short_payloads(spark):
    c = PackedStruct([("ts", "u32"), ("t", "f32"), ("s", "u16")])
    df = spark.createDataFrame([(1, 27.65, 0xAA55)], "a bigint, b double, c int").select(c.encode(F.col("a"), F.col("b"), F.col("c")).alias("p"))
    assert bytes(df.first().p) == struct.pack("<IfH", 1, 27.65, 0xAA55)
    with pytest.raises(Exception, match="shorter"):
        df.select(c.decode(F.substring("p", 1, 9))).collect()


def test_wal_stops_at_every_cut(spark, tmp_path):
    records = [(1, False, b"abc"), (70000 & 0xFFFF, True, b""), (3, False, b"x" * 40)]
    raw = legacy.wal_bytes(records)
    ends = [len(legacy.wal_bytes(records[:n])) for n in range(4)]
    for cut in range(len(raw) + 1):
        assert len(list(legacy.wal_records(raw[:cut]))) == max(n for n in range(4) if ends[n] <= cut)
    (tmp_path / "wal.log").write_bytes(raw + b"\1\2")
    assert legacy.read_wal(spark, str(tmp_path)).count() == 3
    spark.dataSource.register(legacy.WalSource)
    assert spark.read.format("ring_wal").load(str(tmp_path / "wal.log")).count() == 3


def test_sst_files(spark, tmp_path):
    (tmp_path / "lv0_1.sst").write_bytes(legacy.sst_bytes([(5, 10, False, b"v"), (6, 11, True, b"")]))
    (tmp_path / "log_lv0_2.sst").write_bytes(legacy.sst_bytes([(FLASH.vkey_offset + 7 * 2048 + 9, 12, False, b"w")]))
    (tmp_path / "lv0_3.sst.tmp").write_bytes(b"junk")
    assert sorted(r.vkey for r in legacy.read_sst(spark, str(tmp_path)).collect()) == [5, 6]
    log = legacy.read_sst(spark, str(tmp_path), logs=True).select(K.unpack_id(F.col("vkey")), K.unpack_slot(F.col("vkey"))).first()
    assert tuple(log) == (7, 9)
    with pytest.raises(ValueError, match="cut short"):
        list(legacy.sst_records(legacy.sst_bytes([(5, 10, False, b"value")])[:-1]))


def test_streams_match_the_batch(spark, tmp_path):
    from keelson.plans.queries import log_slots

    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    s = src.filter("user_id < 64").select(F.col("user_id").cast("int").alias("id"), F.col("event_id").alias("seq"))
    q = ring.assign_slots(s, 32).writeStream.format("memory").queryName("slots_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("slots_out").select("id", "n", "slot").collect())
    assert got == sorted((r.id, r.seq, r.slot) for r in log_slots(spark, d).collect())
    q = ring.latest_values(src, "user_id", "event_id", "value").writeStream.outputMode("complete").format("memory").queryName("latest_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max_by("value", "event_id")).collect()
    assert sorted((r.user_id, r.value) for r in spark.table("latest_out").collect()) == sorted(tuple(r) for r in want)


def test_flush_split_replays_a_batch(spark, tmp_path):
    write = ring.flush_split(str(tmp_path), FLASH.vkey_offset)
    batch = spark.createDataFrame([(5,), (FLASH.vkey_offset + 1,)], "vkey bigint")
    write(batch, 0)
    write(batch, 0)
    assert spark.read.parquet(str(tmp_path / "kv")).count() == 1 and spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_stored_queries_reach_their_branches(spark):
    """At sf0.01 guards, capacity and merges all have rows on both sides."""
    from keelson.plans import store_queries as Q

    d = "/root/testdata/sf0.01"
    assert {r.status for r in Q.store_rejects(spark, d).collect()} == {"bad_key", "bad_size"}
    assert 0 < Q.store_full(spark, d).count() < Q.kv_rows(spark, d).count()
    assert Q.store_evicts(spark, d).count() == 300
    assert {r.lvl for r in Q.store_audit(spark, d).collect()} == {0, 1, None}


def test_cached_reads_follow_the_newest_version(spark, tmp_path):
    e = Engine(spark, str(tmp_path), cache=True)
    assert e.put(1, b"a") and e.get(1) == b"a" and e.store.read().is_cached and e.store.read() is e.store.read()
    old = e.store.read()
    assert e.put(1, b"b") and e.get(1) == b"b" and not old.is_cached
    e.compact()
    assert e.get(1) == b"b" and e.format() and e.get(1) is None
    assert not Engine(spark, str(tmp_path / "plain")).store.read().is_cached


def test_merged_files_have_bloom_filters(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    rows = spark.range(2000).select(F.col("id").alias("key"), F.col("id").alias("seq"), F.col("id").alias("ts"), F.lit(False).alias("tombstone"), F.lit(b"v").alias("payload"))
    e.write_batch(rows)
    e.compact()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = [f for f in tmp_path.glob("base-*/*.parquet")]
    assert files
    for f in files:
        at = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(str(f)), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
        for block in reader.getRowGroups():
            offsets = {c.getPath().toDotString(): c.getBloomFilterOffset() for c in block.getColumns()}
            assert offsets["id"] > 0 > offsets["seq"]
        reader.close()


def test_record_sinks_round_trip(spark, tmp_path):
    spark.dataSource.register(legacy.WalSource)
    spark.dataSource.register(legacy.SstSource)
    rows = [(k % 50, k % 7 == 0, b"" if k % 7 == 0 else b"p" * (k % 300)) for k in range(1, 400)]
    df = spark.createDataFrame([(k, t, bytearray(p)) for k, t, p in rows], "key bigint, tombstone boolean, payload binary").repartition(3)
    df.write.format("ring_wal").option("keyWidth", "4").mode("append").save(str(tmp_path / "w"))
    assert len(list((tmp_path / "w").iterdir())) == 3
    got = legacy.read_wal(spark, str(tmp_path / "w"), 4).collect()
    assert sorted((r.key, r.tombstone, bytes(r.payload)) for r in got) == sorted((k, t or not p, p) for k, t, p in rows)
    df.selectExpr("key as vkey", "key as ts", "tombstone", "payload").write.format("ring_sst").mode("append").save(str(tmp_path / "s"))
    got = legacy.read_sst(spark, str(tmp_path / "s")).collect()
    assert sorted((r.vkey, r.ts, r.tombstone, bytes(r.payload)) for r in got) == sorted((k, k, t, p) for k, t, p in rows)
    bad = df.selectExpr("case when key = 9 then 99999 else key end as key", "tombstone", "payload")
    with pytest.raises(Exception, match="format requires"):
        bad.write.format("ring_wal").mode("append").save(str(tmp_path / "b"))
    assert not [f for f in (tmp_path / "b").iterdir() if not f.name.startswith(".")]
