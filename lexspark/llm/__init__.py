"""Training-data operators: deduplication, packing, scoring, tokenising, search.

Nothing outside this subpackage imports it.
"""
