"""Training-data operators: deduplication, filtering, extraction, formatting, packing.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries
when it is present.
"""
