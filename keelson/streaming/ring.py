"""Continuous ingest: slots by keyed state, and the latest value per key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "id int, seq bigint, n bigint, slot int"


class RingWriter(StatefulProcessor):
    """Keeps the append count of each id; rows of a micro-batch are numbered by seq."""

    def __init__(self, slots: int):
        self.slots = slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timer_values):
        seqs = pd.concat([r["seq"] for r in rows]).sort_values(ignore_index=True)
        n = self.count.get()[0] if self.count.exists() else 0
        ns = pd.Series(range(n, n + len(seqs)), dtype="int64")
        self.count.update((n + len(seqs),))
        yield pd.DataFrame({"id": key[0], "seq": seqs, "n": ns, "slot": (ns % self.slots).astype("int32")})

    def close(self) -> None:
        pass


def assign_slots(stream: DataFrame, slots: int) -> DataFrame:
    """(id, seq) in, (id, seq, n, slot) out. Needs the RocksDB state store."""
    return stream.select("id", "seq").groupBy("id").transformWithStateInPandas(RingWriter(slots), OUT, "Append", "None")


def latest_values(stream: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """Newest value of each key; write it in complete or update mode."""
    return stream.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def flush_split(root: str, offset: int):
    """foreachBatch sink: KV and log rows of a micro-batch to tables of their own, told apart by the virtual key.

    The folder carries the batch id, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for name, part in (("kv", F.col("vkey") < offset), ("log", F.col("vkey") >= offset)):
            batch.filter(part).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    return write
