"""Operators of a large-scale training-data pipeline, each a Spark job over ``documents``.

Nothing outside this folder imports it except ``__spark_entry__`` (guarded) and
``corpus_pipeline``.
"""
