"""Operators of a training-data pipeline (see README, "Training-data operators").

Nothing outside this package imports it; ``corpus_pipeline.py`` and
``triageflow.llm.queries`` build on it.
"""
