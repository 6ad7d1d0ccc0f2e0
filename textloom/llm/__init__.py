"""Operators for building training data: deduplication, filtering, mixing, personal data, tokens and archives.

Nothing outside this folder, corpus_pipeline.py and the guarded import in __spark_entry__.py uses it.
"""
