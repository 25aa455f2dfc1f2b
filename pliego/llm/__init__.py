"""Operators for building large text corpora (filters, dedup, scoring, encoding).

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
