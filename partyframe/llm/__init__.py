"""Operators for preparing training data: quality, language, duplicates, leaks, toxicity, packing, shards.

Nothing outside this subpackage imports it, apart from ``__spark_entry__.py``
and ``corpus_pipeline.py``.
"""
