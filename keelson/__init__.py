"""keelson: versioned key-value and ring-log analytics on Spark."""

__version__ = "0.1.0"
