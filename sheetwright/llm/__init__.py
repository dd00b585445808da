"""Training-data operators: deduplication, mixing, tokenising, archives, extraction.

Nothing outside this subpackage imports it.
"""
