"""Corpus operators for training-data pipelines: one module per operator.

Nothing else in the package imports this one. ``queries.py`` holds the
registered queries, ``corpus_pipeline.py`` (repository top) the pipeline.
"""
