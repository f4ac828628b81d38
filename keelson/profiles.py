"""Capacity profiles and engine options."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    """Limits of one deployment profile. Fixed values of the two presets follow below."""

    name: str
    max_levels: int
    kv_keys: int
    max_entries: int
    memtable_entries: int
    cache_bytes: int
    compaction_kb: int
    bloom_bytes: int
    bloom_hashes: int
    log_ids: int
    log_history: int
    slot_bits: int
    payload_limit: int = 65535
    string_cap: int = 128
    on_full: str = "evict"

    @property
    def slots(self) -> int:
        return 1 << self.slot_bits

    @property
    def vkey_offset(self) -> int:
        """First virtual key of the log namespace, as a 64-bit number."""
        return 0xFFFFFFFF - self.log_ids * self.slots

    def with_ring(self, slot_bits: int, history: int) -> Profile:
        return replace(self, slot_bits=slot_bits, log_history=history)

    def with_string_cap(self, cap: int) -> Profile:
        """A cap outside 1..1024 is ignored."""
        return replace(self, string_cap=cap) if 1 <= cap <= 1024 else self

    def with_policy(self, on_full: str) -> Profile:
        if on_full not in ("evict", "reject"):
            raise ValueError("on_full is 'evict' or 'reject'")
        return replace(self, on_full=on_full)


FLASH = Profile("flash", 4, 2048, 2048, 512, 1024, 16, 64, 4, 64, 1024, 11)
SD = Profile("sd", 5, 2048, 32768, 2048, 4096, 32, 128, 5, 128, 16384, 14)
ENGINE_VERSION = "2.1.3"


def memtable_limit(mem_bytes: int, cache_bytes: int, heap_share: float, l0_files: int) -> int:
    """Adaptive write-buffer limit in bytes; on Spark it feeds maxBytesPerTrigger."""
    score = 0.5 * mem_bytes / cache_bytes + 0.3 * (1 - heap_share) + 0.2 * l0_files
    return 8192 if score < 0.3 else 4096 if score < 0.6 else 2048


#: L0 files that force a compaction, then files per level that start one.
L0_URGENT = 6
LEVEL_TRIGGERS = (2, 4, 8, 16)


def compaction_level(files_per_level: list[int], log: bool = False) -> int | None:
    """Level to merge into the next one, or None. Logs only merge L0, and only when it is urgent."""
    if files_per_level and files_per_level[0] > L0_URGENT:
        return 0
    if log:
        return None
    return next((k for k, (n, least) in enumerate(zip(files_per_level[:-1], LEVEL_TRIGGERS, strict=False)) if n >= least), None)
