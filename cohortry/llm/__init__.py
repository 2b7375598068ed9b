"""Operators of a training-data pipeline over raw documents and web pages.

Nothing else in the library imports this subpackage.  Every operator takes and returns DataFrames,
works on whole texts and leaves foreign columns alone.
"""
