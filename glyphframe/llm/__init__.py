"""Training-data operators: tokens, near and exact duplicates, packing, search, extraction and quality.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; the thin queries that the
driver runs are in :mod:`glyphframe.llm.queries`.
"""
