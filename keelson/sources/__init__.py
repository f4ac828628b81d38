"""Storage: the Parquet version store, wire frames and legacy binary readers."""
