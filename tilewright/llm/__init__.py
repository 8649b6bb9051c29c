"""Operators for preparing training data: packing, scoring, tokenizing and deduplication.

Nothing outside this subpackage imports it.  Every operator reads only the id and
text columns that it is told of, so further columns, whatever their names, never clash.
"""
