"""Operators for preparing text corpora at scale.

Nothing outside this package imports it; `__spark_entry__.py` adds its queries if it is present.
"""
