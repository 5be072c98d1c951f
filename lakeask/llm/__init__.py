"""Operators of a training-data pipeline: quality, token counts, near and exact dedup, BPE, language ID, sharding,
secret scans and packing. Nothing outside this subpackage imports it."""
