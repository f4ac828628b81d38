"""Packed struct codec: a Spark struct to and from little-endian bytes.

Float bits have no JVM built-in, so this is an Arrow-batched pandas UDF; lookups and scans never need it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field kinds: numpy type and Spark type.
KINDS = {"u8": ("<u1", "int"), "u16": ("<u2", "int"), "u32": ("<u4", "bigint"), "i32": ("<i4", "int"), "f32": ("<f4", "float"), "f64": ("<f8", "double")}


class PackedStruct:
    """Fields as (name, kind). Decoding fails on a payload shorter than the struct."""

    def __init__(self, fields: Sequence[tuple[str, str]]):
        self.fields = list(fields)
        self.dtype = np.dtype([(n, KINDS[k][0]) for n, k in self.fields])
        self.ddl = ", ".join(f"`{n}` {KINDS[k][1]}" for n, k in self.fields)

    def pack(self, *values) -> bytes:
        """One record's bytes."""
        return np.array([tuple(values)], self.dtype).tobytes()

    def unpack(self, raw: bytes) -> tuple:
        if len(raw) < self.dtype.itemsize:
            raise ValueError(f"payload shorter than the {self.dtype.itemsize} bytes of the struct")
        return np.frombuffer(raw[: self.dtype.itemsize], self.dtype)[0].item()

    def encode(self, *cols: Column) -> Column:
        dtype, names = self.dtype, [n for n, _ in self.fields]

        @F.pandas_udf("binary")
        def pack(rows: pd.DataFrame) -> pd.Series:
            a = np.zeros(len(rows), dtype)
            for n, c in zip(names, rows.columns, strict=True):
                a[n] = rows[c].to_numpy()
            raw, w = a.tobytes(), dtype.itemsize
            return pd.Series([raw[i * w : (i + 1) * w] for i in range(len(rows))])

        return pack(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))

    def decode(self, payload: Column) -> Column:
        dtype, names, ddl = self.dtype, [n for n, _ in self.fields], self.ddl

        @F.pandas_udf(ddl)
        def unpack(p: pd.Series) -> pd.DataFrame:
            w = dtype.itemsize
            if (p.map(len) < w).any():
                raise ValueError(f"payload shorter than the {w} bytes of the struct")
            a = np.frombuffer(b"".join(x[:w] for x in p), dtype)
            return pd.DataFrame({n: a[n] for n in names})

        return unpack(payload)
