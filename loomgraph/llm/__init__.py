"""Operators for large text corpora: near-duplicates, packing, filters, mixing, privacy, language, storage.

Nothing outside this folder imports it. Every operator takes and returns DataFrames, reads only the
columns it names, and leaves other columns alone.
"""
