"""Operators that prepare text corpora for training, one module each.

Every operator takes and returns DataFrames, reads only the columns it names (further columns, also ones whose names
equal its own output columns, are ignored), and treats a null text as the empty text. A null ``doc_id`` is a value
like any other. Nothing outside this package imports it.
"""
