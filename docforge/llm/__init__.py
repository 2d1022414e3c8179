"""Training-data operators: language, private data, packing, duplicates, toxicity, pieces.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; the queries registered for them live in ``queries.py``.
"""
