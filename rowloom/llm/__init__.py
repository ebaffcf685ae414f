"""Training-data operators: deduplication, search, filtering, mixing, sharding, tokenizing.

Nothing outside this subpackage imports it.
"""
