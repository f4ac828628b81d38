"""A Parquet version store with an atomically replaced manifest, and the engine facade over it.

Layout under the root: ``delta-N`` folders of appended versions, at most one ``base-N`` per compaction,
``state-N`` (appends per log id), and ``manifest-N.json``. The newest manifest names the live folders; a reader
keeps the snapshot that it opened, as no folder is changed in place. All paths go through Hadoop's filesystem
API, so any store that Spark reads will do.

One writer per store. Point calls (put, get) are driver-side conveniences; bulk calls take DataFrames.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.codec import PackedStruct
from ..operators import versions as V
from ..profiles import ENGINE_VERSION, FLASH, Profile, compaction_level, memtable_limit
from . import legacy

ENVELOPE = "ns string, id bigint, slot int, seq bigint, ts bigint, tombstone boolean, payload binary"
COLUMNS = ["ns", "id", "slot", "seq", "ts", "tombstone", "payload"]
#: live is an upper bound of the live rows: rows written since it was last counted are added to it.
EMPTY = {"version": 0, "folders": [], "state": None, "next_seq": 1, "live": 0}

#: A column with a dictionary gets no Bloom filter.
BLOOM = {"parquet.bloom.filter.enabled#id": "true", "parquet.enable.dictionary#id": "false"}


class Store:
    """With cache, the rows of the newest manifest that was read stay in the executors' memory and on their disks."""

    def __init__(self, spark: SparkSession, root: str, cache: bool = False):
        self.spark, self.root, self.cache = spark, root.rstrip("/"), cache
        self._cached: tuple[list, DataFrame] | None = None
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self._drop_stale()

    def manifest(self) -> dict:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        found = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not found:
            return dict(EMPTY)
        text = self.spark.read.text(f"{self.root}/manifest-{max(found)}.json", wholetext=True).first()[0]
        return json.loads(text)

    def publish(self, m: dict) -> None:
        """Write beside, then rename: a reader sees the old manifest or the new one."""
        tmp, to = self._path(f"{self.root}/.manifest-{m['version']}"), self._path(f"{self.root}/manifest-{m['version']}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if not self._fs.rename(tmp, to):
            raise OSError(f"version {m['version']} was published by another writer")

    def read(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        if not m["folders"]:
            return self.spark.createDataFrame([], ENVELOPE)
        if self._cached and self._cached[0] == m["folders"]:
            return self._cached[1]
        rows = self.spark.read.schema(ENVELOPE).parquet(*[f"{self.root}/{f}" for f in m["folders"]])
        if self.cache:
            self.uncache()
            self._cached = m["folders"], rows.persist()
        return rows

    def uncache(self) -> None:
        if self._cached:
            self._cached[1].unpersist()
            self._cached = None

    def counts(self, m: dict) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{m['state']}") if m["state"] else None

    def append(self, rows: DataFrame, state: DataFrame | None = None) -> dict:
        """Rows carry seq already. Sorted by key within files, so row-group statistics skip."""
        m = self.manifest()
        n = m["version"] + 1
        rows.select(*COLUMNS).sortWithinPartitions("ns", "id", "slot").write.mode("overwrite").parquet(f"{self.root}/delta-{n}")
        top, puts = self.spark.read.parquet(f"{self.root}/delta-{n}").agg(F.max("seq"), F.count_if(~F.col("tombstone"))).first()
        m |= {"version": n, "folders": [*m["folders"], f"delta-{n}"], "next_seq": max(m["next_seq"], (top or 0) + 1), "live": m["live"] + puts}
        if state is not None:
            state.write.mode("overwrite").parquet(f"{self.root}/state-{n}")
            m["state"] = f"state-{n}"
        self.publish(m)
        return m

    def compact(self, history: int) -> dict:
        """Merge everything into one base: newest versions, tombstones dropped, log history cut to `history` slots per id."""
        m = self.manifest()
        n, v = m["version"] + 1, self.read(m)
        kv = V.latest_live(v.filter("ns = 'kv'"), ["ns", "id", "slot"])
        log = V.log_retention(v.filter("ns = 'log'").drop("ns"), history).withColumn("ns", F.lit("log"))
        out = kv.unionByName(log).select(*COLUMNS).repartitionByRange("ns", "id", "slot").sortWithinPartitions("ns", "id", "slot")
        out.write.mode("overwrite").options(**BLOOM).parquet(f"{self.root}/base-{n}")
        m |= {"version": n, "folders": [f"base-{n}"]}
        self.publish(m)
        return m

    def live(self, least: int) -> int:
        """Live rows; only an upper bound where that is below `least`, so that a store with room isn't scanned."""
        m = self.manifest()
        if m["live"] < least:
            return m["live"]
        n = V.live_count(self.read(m), ["ns", "id", "slot"]).first()[0]
        if n != m["live"]:
            self.publish(m | {"version": m["version"] + 1, "live": n})
        return n

    def used(self) -> int:
        """Bytes of the live folders."""
        return sum(int(self._fs.getContentSummary(self._path(f"{self.root}/{f}")).getLength()) for f in self.manifest()["folders"])

    def vacuum(self) -> None:
        """Delete folders and manifests that the newest manifest doesn't name. Run it when no reader holds an older snapshot."""
        m = self.manifest()
        keep = {*m["folders"], m["state"], f"manifest-{m['version']}.json"}
        for s in self._fs.listStatus(self._path(self.root)):
            if s.getPath().getName() not in keep:
                self._fs.delete(s.getPath(), True)

    def clear(self) -> None:
        self.uncache()
        self._fs.delete(self._path(self.root), True)
        self._fs.mkdirs(self._path(self.root))

    def files(self) -> DataFrame:
        """(folder, bytes) of the live folders."""
        m = self.manifest()
        sizes = [(f, int(self._fs.getContentSummary(self._path(f"{self.root}/{f}")).getLength())) for f in m["folders"]]
        return self.spark.createDataFrame(sizes, "folder string, bytes bigint")

    def _drop_stale(self) -> None:
        """Leftovers of a writer that died before publishing."""
        for s in self._fs.listStatus(self._path(self.root)):
            if s.getPath().getName().startswith(".manifest-"):
                self._fs.delete(s.getPath(), False)


class Engine:
    """Key-value and ring-log calls over a Store. Opening it twice is harmless; it has no background task.

    storage_bytes is the room for files: beyond nine tenths of it the store counts as full. With auto, every bulk or
    point write is followed by tick(). With cache, reads keep the rows of the newest version (see Store).
    """

    version = ENGINE_VERSION

    def __init__(self, spark: SparkSession, root: str, profile: Profile = FLASH, clock=None, storage_bytes: int | None = None, auto: bool = False, cache: bool = False):
        self.spark, self.profile, self.store = spark, profile, Store(spark, root, cache)
        self.storage_bytes, self.auto = storage_bytes, auto
        self._clock = clock or (lambda seq: seq)

    # writes

    def _row(self, ns: str, key: int, slot: int | None, payload: bytes | None, tombstone: bool, state: DataFrame | None = None) -> None:
        seq = self.store.manifest()["next_seq"]
        row = (ns, key, slot, seq, self._clock(seq), tombstone or not payload, bytearray(payload or b""))
        self.store.append(self.spark.createDataFrame([row], ENVELOPE).coalesce(1), state)
        self._written()

    def put(self, key: int, payload: bytes) -> bool:
        """False when the key or size is out of bounds, or the store is full and the policy is to reject. No bytes: a delete."""
        p = self.profile
        if not 0 <= key < p.kv_keys or len(payload) > p.payload_limit or not self._room():
            return False
        self._row("kv", key, None, payload, False)
        return True

    def put_string(self, key: int, text: str) -> bool:
        return self.put(key, text.encode() + b"\0")

    def delete(self, key: int) -> bool:
        """True even when the key never existed."""
        if not 0 <= key < self.profile.kv_keys:
            return False
        self._row("kv", key, None, None, True)
        return True

    def put_struct(self, key: int, codec: PackedStruct, *values) -> bool:
        return self.put(key, codec.pack(*values))

    def write_batch(self, kv: DataFrame) -> DataFrame:
        """Append (key, seq, ts, tombstone, payload) in bulk and return the rejects with their status: bad_key, bad_size or
        full. seq counts within the batch. At the capacity the policy holds as for single writes, in the order of seq: evict
        tombstones the oldest live rows beyond it; reject takes no put once the store is full."""
        base = self.store.manifest()["next_seq"]
        checked = V.guard_kv(kv.withColumn("tombstone", F.coalesce("tombstone", F.lit(False))), self.profile.kv_keys, "payload", self.profile.payload_limit)
        rows = V.empty_is_tombstone(checked, "payload").select("*", F.lit("kv").alias("ns"), F.col("key").cast("bigint").alias("id"), F.lit(None).cast("int").alias("slot"))
        ok = F.col("status") == "ok"
        last = self._last_fitting(rows.filter(ok))
        status = F.when(ok & ~F.col("tombstone") & (F.col("seq") > last), "full").otherwise(F.col("status"))
        rows = rows.withColumn("status", status if last is not None else F.col("status"))
        self.store.append(rows.filter(ok).withColumn("seq", F.col("seq") + base))
        self._written()
        return rows.filter(F.col("status") != "ok").select(*kv.columns, "status")

    def write_logs(self, appends: DataFrame) -> DataFrame:
        """Append (id, seq, ts, payload) in bulk: slots go on from each id's stored count. Returns the rejects: ids that are
        null or out of bounds, payloads over the limit, and what a full store takes no more (see write_batch). A null or
        empty payload is a tombstone in its slot."""
        m, p = self.store.manifest(), self.profile
        outside = F.col("id").isNull() | (F.col("id") < 0) | (F.col("id") >= p.log_ids)
        bad = outside | (F.coalesce(F.octet_length("payload"), F.lit(0)) > p.payload_limit)
        counts = self.store.counts(m)
        rows = V.assign_slots(appends.filter(~bad), p.slots, ["seq"], counts and counts.withColumnRenamed("n", "n_before"))
        rows = V.empty_is_tombstone(rows.withColumn("tombstone", F.lit(False)), "payload").withColumns({"ns": F.lit("log"), "id": F.col("id").cast("bigint")})
        last = self._last_fitting(rows)
        over = F.lit(False) if last is None else F.col("seq") > last
        state = appends.filter(~bad & ~over).groupBy(F.col("id").cast("bigint").alias("id")).agg(F.count("*").alias("n"))
        if counts is not None:
            state = counts.withColumn("id", F.col("id").cast("bigint")).unionByName(state).groupBy("id").agg(F.sum("n").alias("n"))
        self.store.append(rows.filter(~over).withColumn("seq", F.col("seq") + m["next_seq"]), state)
        self._written()
        return appends.filter(bad | over)

    def _last_fitting(self, rows: DataFrame) -> int | None:
        """Under the reject policy, the seq after which a batch (ns, id, slot, seq, tombstone) finds the store full; None if it fits."""
        if self.profile.on_full != "reject":
            return None
        if self._nearly_full():
            return -(2**62)
        most, keys = self.profile.max_entries, ["ns", "id", "slot"]
        room = most - self.store.live(most - rows.count())
        have = V.latest_live(self.store.read(), keys).select("ns", "id", F.coalesce("slot", F.lit(-1)).alias("slot"))
        first = rows.filter(~F.col("tombstone")).groupBy("ns", "id", F.coalesce("slot", F.lit(-1)).alias("slot")).agg(F.min("seq").alias("seq"))
        fit = first.join(have, keys, "left_anti").orderBy("seq").limit(max(room, 0) + 1).agg(F.count("*").alias("n"), F.max("seq").alias("seq")).first()
        if room <= 0:
            return -(2**62)
        return fit.seq - 1 if fit.n > room else None

    def _written(self) -> None:
        """After a write: evict what is beyond the capacity, and let the scheduler work if it is automatic."""
        if self.profile.on_full == "evict":
            over = self.store.live(self.profile.max_entries + 1) - self.profile.max_entries
            if over > 0:
                self.evict(over)
        if self.auto:
            self.tick()

    def _nearly_full(self) -> bool:
        return self.storage_bytes is not None and self.store.used() >= self.storage_bytes * 9 // 10

    def tick(self) -> int | None:
        """One turn of the scheduler: the level that the file counts ask to merge, after merging it, or None."""
        folders = self.store.manifest()["folders"]
        deltas = sum(f.startswith("delta-") for f in folders)
        level = compaction_level([deltas, len(folders) - deltas, 0])
        if level is not None:
            self.compact()
        return level

    def bytes_per_trigger(self, mem_bytes: int, heap_share: float) -> int:
        """Adaptive write-buffer limit, for maxBytesPerTrigger of a stream that feeds this store."""
        deltas = sum(f.startswith("delta-") for f in self.store.manifest()["folders"])
        return memtable_limit(mem_bytes, self.profile.cache_bytes, heap_share, deltas)

    def import_sst(self, path: str) -> None:
        """Load the sorted-table files of a folder, key-value and log ones: newer time stamps win, then later files."""
        kv, log = legacy.read_sst(self.spark, path), legacy.read_sst(self.spark, path, logs=True)
        self._import(kv.unionByName(log).withColumn("at", F.struct("ts", "path", "n")))

    def import_wal(self, path: str, key_width: int = 2) -> None:
        """Replay write-ahead logs, files in the order of their names, up to the first broken frame of each."""
        wal = legacy.read_wal(self.spark, path, key_width)
        self._import(wal.withColumnRenamed("key", "vkey").withColumns({"ts": F.lit(0).cast("bigint"), "at": F.struct("path", "n")}))

    def _import(self, rows: DataFrame) -> None:
        """Rows (vkey, ts, tombstone, payload, at) in the order of at, numbered with gaps by sorted partitions. Counts of log ids go on after their highest slot."""
        m, p = self.store.manifest(), self.profile
        log = K.is_log(F.col("vkey"), p)
        rows = V.empty_is_tombstone(rows, "payload").orderBy("at").withColumns({"seq": F.monotonically_increasing_id() + m["next_seq"], "ns": F.when(log, "log").otherwise("kv")})
        rows = rows.withColumns({"slot": F.when(log, K.unpack_slot(F.col("vkey"), p)), "id": F.when(log, K.unpack_id(F.col("vkey"), p)).otherwise(F.col("vkey")).cast("bigint"), "seq": F.col("seq").cast("bigint")})
        state = rows.filter("ns = 'log'").groupBy("id").agg((F.max("slot") + 1).cast("bigint").alias("n"))
        counts = self.store.counts(m)
        if counts is not None:
            state = counts.withColumn("id", F.col("id").cast("bigint")).unionByName(state).groupBy("id").agg(F.max("n").alias("n"))
        self.store.append(rows, state)
        self._written()

    def put_log(self, log_id: int, payload: bytes) -> bool:
        if not 0 <= log_id < self.profile.log_ids or len(payload) > self.profile.payload_limit or not self._room():
            return False
        seq = self.store.manifest()["next_seq"]
        self.write_logs(self.spark.createDataFrame([(log_id, 0, self._clock(seq), bytearray(payload))], "id bigint, seq bigint, ts bigint, payload binary"))
        return True

    def put_log_struct(self, log_id: int, codec: PackedStruct, *values) -> bool:
        return self.put_log(log_id, codec.pack(*values))

    def get_log_struct(self, log_id: int, codec: PackedStruct, slot: int | None = None) -> tuple | None:
        raw = self.get_log(log_id, slot)
        return codec.unpack(raw) if raw is not None else None

    def delete_log(self, log_id: int) -> bool:
        """Tombstone every live slot; true when nothing lives. The id's append count goes on."""
        if not 0 <= log_id < self.profile.log_ids:
            return False
        m = self.store.manifest()
        gone = V.log_delete(self.logs(), log_id, m["next_seq"])
        self.store.append(gone.select(F.lit("log").alias("ns"), *COLUMNS[1:]))
        return True

    def flush(self) -> None:
        """Writes are durable when they return; nothing is left to flush."""

    def compact(self) -> None:
        self.store.compact(self.profile.log_history)

    def format(self) -> bool:
        self.store.clear()
        return True

    def evict(self, k: int) -> DataFrame:
        """Tombstone the k oldest live rows of both namespaces."""
        v = self.store.read()
        victims = V.evict_oldest(v, k, ["ns", "id", "slot"])
        self.store.append(V.tombstones_for(victims, self.store.manifest()["next_seq"], ["ns", "id", "slot"]))
        return victims

    def _room(self) -> bool:
        if self.store.live(self.profile.max_entries) < self.profile.max_entries and not self._nearly_full():
            return True
        if self.profile.on_full == "reject":
            return False
        self.evict(1)
        return True

    # reads

    def kv(self) -> DataFrame:
        return self.store.read().filter("ns = 'kv'").select(F.col("id").alias("key"), "seq", "ts", "tombstone", "payload")

    def logs(self) -> DataFrame:
        return self.store.read().filter("ns = 'log'").drop("ns")

    def get(self, key: int) -> bytes | None:
        row = V.get(self.kv(), key).first() if 0 <= key < self.profile.kv_keys else None
        return bytes(row.payload) if row else None

    def get_struct(self, key: int, codec: PackedStruct) -> tuple | None:
        raw = self.get(key)
        return codec.unpack(raw) if raw is not None else None

    def get_string(self, key: int) -> str:
        """Empty when absent or longer than the cap."""
        raw = self.get(key)
        if raw is None or len(raw) > self.profile.string_cap:
            return ""
        return raw.removesuffix(b"\0").decode()

    def get_log(self, log_id: int, slot: int | None = None) -> bytes | None:
        hit = V.log_latest(self.logs().filter(F.col("id") == log_id)) if slot is None else V.log_slot(self.logs(), log_id, slot, self.profile.slots)
        row = hit.first()
        return bytes(row.payload) if row else None

    def total_log(self, log_id: int) -> int:
        row = V.log_total(self.logs().filter(F.col("id") == log_id)).first()
        return row.total if row else 0

    def log_iterator(self, log_id: int, start: int, end: int) -> LogCursor:
        return LogCursor(V.log_range(self.logs(), start, end, self.profile.slots, log_id))

    def export_kv(self) -> DataFrame:
        """(key, payload, frame) of every live pair."""
        return V.export(self.kv(), ["key"], "payload").select("key", "payload", K.kv_frame(F.col("key"), F.col("payload")).alias("frame"))

    def export_logs(self) -> DataFrame:
        return V.export(self.logs(), ["id", "slot"], "payload").select("id", "slot", "payload", K.log_frame(F.col("id"), F.col("slot"), F.col("payload")).alias("frame"))

    def audit(self) -> DataFrame:
        v = self.store.read().withColumns({"file_id": F.input_file_name(), "bytes": F.octet_length("payload") + 13})
        return V.level_audit(v.withColumn("lvl", F.when(F.col("file_id").contains("/base-"), 1).otherwise(0)))

    def audit_files(self) -> DataFrame:
        """Per file: namespace, level, entries, tombstones, payload bytes and the range of ids."""
        v = self.store.read().withColumns({"file": F.input_file_name(), "bytes": F.octet_length("payload") + 13})
        v = v.withColumn("lvl", F.when(F.col("file").contains("/base-"), 1).otherwise(0))
        return v.groupBy("file", "ns", "lvl").agg(F.count("*").alias("n_entries"), F.sum(F.col("tombstone").cast("bigint")).alias("n_tombstones"), F.sum("bytes").alias("n_bytes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))

    def export_stream(self, path: str, logs: bool = False) -> int:
        """All live frames as one byte stream in one file, in key order; gives its length. Rows pass through the driver one
        partition at a time, as a single stream asks for."""
        frames = self.export_logs().orderBy("id", "slot") if logs else self.export_kv().orderBy("key")
        fs, to = self.store._fs, self.store._path(path)
        out, n = fs.create(to, True), 0
        try:
            for r in frames.select("frame").toLocalIterator():
                out.write(bytearray(r.frame))
                n += len(r.frame)
        finally:
            out.close()
        return n

    def gauges(self, capacity: int) -> DataFrame:
        return V.gauges(self.store.files(), capacity)


class LogCursor:
    """Slot-ordered cursor over one snapshot. Before the first next() and after close(), slot and ts are 0."""

    def __init__(self, rows: DataFrame):
        self._rows: Iterator | None = rows.toLocalIterator()
        self._at = None

    def next(self) -> bool:
        self._at = next(self._rows, None) if self._rows is not None else None
        return self._at is not None

    @property
    def slot(self) -> int:
        return self._at.slot if self._at else 0

    @property
    def ts(self) -> int:
        return self._at.ts if self._at else 0

    @property
    def value(self) -> bytes | None:
        return bytes(self._at.payload) if self._at else None

    def close(self) -> None:
        self._rows = self._at = None


def write_frames(frames: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Wire sink: frames as one binary column, a Parquet part per task; read back and concatenate in any order."""
    (frames.orderBy(*order) if order else frames).select("frame").write.mode("overwrite").parquet(path)
