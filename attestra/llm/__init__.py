"""Operators that prepare text corpora for language-model training.

Every operator takes and returns DataFrames.  Nothing outside this package
imports it, so that it can be removed without touching the rest.
"""
