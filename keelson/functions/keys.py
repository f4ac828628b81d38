"""Virtual keys, little-endian byte packing and checksums, as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profiles import FLASH, Profile


def pack_vkey(log_id: Column, slot: Column, p: Profile = FLASH) -> Column:
    """64-bit, as the log namespace lies above the signed 32-bit range."""
    return F.lit(p.vkey_offset).cast("bigint") + F.shiftleft(log_id.cast("bigint"), p.slot_bits) + slot.cast("bigint")


def unpack_id(vkey: Column, p: Profile = FLASH) -> Column:
    return F.shiftright(vkey - F.lit(p.vkey_offset).cast("bigint"), p.slot_bits).cast("int")


def unpack_slot(vkey: Column, p: Profile = FLASH) -> Column:
    return (vkey - F.lit(p.vkey_offset).cast("bigint")).bitwiseAND(F.lit(p.slots - 1).cast("bigint")).cast("int")


def is_log(vkey: Column, p: Profile = FLASH) -> Column:
    return vkey >= F.lit(p.vkey_offset).cast("bigint")


def little_endian(c: Column, width: int) -> Column:
    """The low `width` bytes of an integer, least significant first."""
    c = c.cast("bigint")
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(F.lit(255).cast("bigint"))), 2, "0")) for k in range(width)])


def kv_frame(key: Column, payload: Column) -> Column:
    return F.concat(little_endian(key, 2), little_endian(F.octet_length(payload), 2), payload)


def log_frame(log_id: Column, slot: Column, payload: Column) -> Column:
    return F.concat(little_endian(log_id, 2), little_endian(slot, 2), little_endian(F.octet_length(payload), 2), payload)


def wal_frame(key: Column, payload: Column, tombstone: Column, key_width: int = 2) -> Column:
    """key, size, payload, tombstone byte, CRC-32 of all before it."""
    body = F.concat(little_endian(key, key_width), little_endian(F.octet_length(payload), 4), payload, little_endian(tombstone.cast("int"), 1))
    return F.concat(body, little_endian(F.crc32(body), 4))


def nul_terminated(c: Column) -> Column:
    return F.concat(F.encode(c, "UTF-8"), F.unhex(F.lit("00")))


def decode_string(payload: Column) -> Column:
    """UTF-8 text without its closing NUL."""
    text = F.decode(payload, "UTF-8")
    return F.when(text.endswith("\0"), F.substring(text, 1, F.length(text) - 1)).otherwise(text)


def namespace_split(v: DataFrame, p: Profile = FLASH) -> tuple[DataFrame, DataFrame]:
    """(KV rows, log rows) of a table with a vkey column."""
    return v.filter(~is_log(F.col("vkey"), p)), v.filter(is_log(F.col("vkey"), p))
