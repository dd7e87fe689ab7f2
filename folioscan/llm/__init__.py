"""Operators for training-data corpora: tokenizing, media, mixing, dedup, filters and binary output.

Nothing else in the library imports this subpackage.
"""
