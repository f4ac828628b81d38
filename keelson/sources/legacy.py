"""Readers and writers of the binary record files: sorted-table files and write-ahead logs.

``binaryFile`` gives whole files, which these formats keep small; parsing is Arrow-batched. A sorted-table file
has records of key u32, size u32, ts u32, tombstone u8, payload. A write-ahead log has frames of key, size u32,
payload, tombstone u8 and a CRC-32 of the frame; reading stops at the first short, oversize or bad frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SST_HEADER = struct.Struct("<IIIB")
SST_SCHEMA = "path string, n bigint, vkey bigint, ts bigint, tombstone boolean, payload binary"
WAL_SCHEMA = "path string, n bigint, key bigint, tombstone boolean, payload binary"


def sst_records(raw: bytes) -> Iterator[tuple[int, int, bool, bytes]]:
    """(vkey, ts, tombstone, payload). A record cut short fails."""
    at = 0
    while at < len(raw):
        if at + SST_HEADER.size > len(raw):
            raise ValueError(f"record header cut short at byte {at}")
        key, size, ts, tomb = SST_HEADER.unpack_from(raw, at)
        at += SST_HEADER.size
        if at + size > len(raw):
            raise ValueError(f"payload cut short at byte {at}")
        yield key, ts, tomb == 1, raw[at : at + size]
        at += size


def sst_bytes(records) -> bytes:
    return b"".join(SST_HEADER.pack(k, len(p), ts, int(tomb)) + p for k, ts, tomb, p in records)


def wal_records(raw: bytes, key_width: int = 2, size_limit: int = 65535) -> Iterator[tuple[int, bool, bytes]]:
    """(key, tombstone, payload) up to the first frame that isn't whole. A live empty payload is a tombstone."""
    head, at = struct.Struct("<HI" if key_width == 2 else "<II"), 0
    while at + head.size <= len(raw):
        key, size = head.unpack_from(raw, at)
        end = at + head.size + size + 1
        if size > size_limit or end + 4 > len(raw) or zlib.crc32(raw[at:end]) != struct.unpack_from("<I", raw, end)[0]:
            return
        yield key, raw[end - 1] == 1 or size == 0, raw[at + head.size : end - 1]
        at = end + 4


def wal_bytes(records, key_width: int = 2) -> bytes:
    out = []
    for key, tomb, payload in records:
        body = struct.pack("<HI" if key_width == 2 else "<II", key, len(payload)) + payload + bytes([tomb])
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return b"".join(out)


def read_sst(spark: SparkSession, path: str, logs: bool = False) -> DataFrame:
    """All records of the sorted-table files in a folder; log files have a prefix of their own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "log_lv*.sst" if logs else "lv*.sst").load(path)

    def parse(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                rows = [(p, n, *r) for n, r in enumerate(sst_records(bytes(raw)))]
                yield pd.DataFrame(rows, columns=["path", "n", "vkey", "ts", "tombstone", "payload"])

    return files.select("path", "content").mapInPandas(parse, SST_SCHEMA)


def read_wal(spark: SparkSession, path: str, key_width: int = 2) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)

    def parse(batches):
        for b in batches:
            for p, raw in zip(b["path"], b["content"], strict=True):
                rows = [(p, n, *r) for n, r in enumerate(wal_records(bytes(raw), key_width))]
                yield pd.DataFrame(rows, columns=["path", "n", "key", "tombstone", "payload"])

    return files.select("path", "content").mapInPandas(parse, WAL_SCHEMA)


def _open_at(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (pafs.LocalFileSystem(), where)


class WalSource(DataSource):
    """Write-ahead logs as a registered source and sink.

    spark.read.format("ring_wal").load(path) gives the frames, a partition per file of a comma-separated list;
    df.write.format("ring_wal").mode("append").save(folder) writes (key, tombstone, payload), a file per task. Files are
    named by task number, so logs of sorted rows are replayed in their order.
    """

    @classmethod
    def name(cls) -> str:
        return "ring_wal"

    def schema(self) -> str:
        return "key bigint, tombstone boolean, payload binary"

    def _width(self) -> int:
        return int(self.options.get("keyWidth", "2"))

    def reader(self, schema) -> DataSourceReader:
        return _WalReader(self.options["path"], self._width())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        width = self._width()
        return _RecordWriter(self.options["path"], "wal_{:05d}.log", lambda rows: wal_bytes(((r.key, bool(r.tombstone), bytes(r.payload or b"")) for r in rows), width))


class SstSource(DataSource):
    """Sink of sorted-table files: df.write.format("ring_sst").option("prefix", "log_lv0").mode("append").save(folder) writes
    (vkey, ts, tombstone, payload), a file per task; sort rows within partitions by vkey."""

    @classmethod
    def name(cls) -> str:
        return "ring_sst"

    def schema(self) -> str:
        return "vkey bigint, ts bigint, tombstone boolean, payload binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        prefix = self.options.get("prefix", "lv0")
        return _RecordWriter(self.options["path"], prefix + "_{:05d}.sst", lambda rows: sst_bytes((r.vkey, r.ts, bool(r.tombstone), bytes(r.payload or b"")) for r in rows))


@dataclass
class _Written(WriterCommitMessage):
    part: str
    final: str


class _RecordWriter(DataSourceWriter):
    """Each attempt of a task writes a hidden file of its own; commit renames those of the attempts that counted."""

    def __init__(self, folder: str, pattern: str, encode: Callable[[Iterator], bytes]):
        self.folder, self.pattern, self.encode = folder.rstrip("/"), pattern, encode

    def write(self, iterator) -> WriterCommitMessage:
        task = TaskContext.get()
        fs, folder = _open_at(self.folder)
        fs.create_dir(folder)
        final = self.pattern.format(task.partitionId())
        part = f".{final}.{task.taskAttemptId()}"
        with fs.open_output_stream(f"{folder}/{part}") as f:
            f.write(self.encode(iterator))
        return _Written(part, final)

    def commit(self, messages) -> None:
        fs, folder = _open_at(self.folder)
        for m in messages:
            fs.move(f"{folder}/{m.part}", f"{folder}/{m.final}")

    def abort(self, messages) -> None:
        fs, folder = _open_at(self.folder)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.part}")


class _WalReader(DataSourceReader):
    def __init__(self, path: str, key_width: int):
        self.path, self.key_width = path, key_width

    def partitions(self):
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition):
        fs, at = _open_at(partition.value)
        with fs.open_input_stream(at) as f:
            yield from wal_records(f.read(), self.key_width)
