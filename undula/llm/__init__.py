"""Operators for large text corpora: fingerprints, deduplication, filtering, tokenising and scoring.

Nothing else in the library imports this subpackage.  Every operator takes a DataFrame and the names
of its id and text columns, selects just those (so further columns, whatever their names, never
clash) and returns one DataFrame.
"""
