"""Training-data operators: extraction, filtering, deduplication, tokenisation, search and packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames and keeps its own
general interface; ``queries.py`` derives the digests that ``__spark_entry__.py`` registers.
"""
