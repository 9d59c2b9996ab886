"""Operators that prepare text and media corpora for language-model training.

Nothing outside this package imports it; ``corpus_pipeline.py`` and the
query module next to this file are its only users.
"""
