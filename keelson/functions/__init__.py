"""Scalar helpers: key packing, little-endian bytes, checksums and struct codecs."""
