"""Operators of a training-data pipeline: deduplication, tokenisation, quality, sharding, packing, extraction.

Nothing outside this subpackage imports it.
"""
