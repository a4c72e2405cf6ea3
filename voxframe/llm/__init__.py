"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames over ``(doc_id, text)`` tables and
selects the columns it needs by name, so further columns never clash. A NULL
text counts as an empty one. Nothing else in the library imports this package.
"""
