"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__`` and
``corpus_pipeline`` use it when it is present.
"""
