"""Operators for large training-text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names, reads only the columns it names (extra or clashing columns
are ignored), and states what nulls, empty texts, repeated rows and empty
tables give in its own docstring.
"""
