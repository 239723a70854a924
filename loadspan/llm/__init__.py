"""Training-data operators: tokenising, packing, deduplication, filtering and extraction on DataFrames.

Nothing outside this subpackage imports it.
"""
