"""Operators for large training-data pipelines, each built on Spark DataFrames.

Nothing outside this package imports it; ``queries`` holds the registered
queries and ``corpus_pipeline.py`` at the repository top chains five of them.
"""
