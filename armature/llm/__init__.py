"""Operators of a training-data pipeline (deduplication, packing, tokenization, search, toxicity).

Nothing else in the library imports this subpackage.
"""
