"""Training-data operators: deduplication, quality, media, secrets, tokens, extraction and packing.

Nothing outside this subpackage imports it.
"""
