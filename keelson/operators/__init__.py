"""Relational operators over the version envelope (key, seq, ts, tombstone, payload)."""
