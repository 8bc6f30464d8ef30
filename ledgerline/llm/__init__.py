"""Operators for large training-corpus pipelines.

Nothing outside this folder (but ``__spark_entry__.py`` and
``corpus_pipeline.py``) imports it.
"""
