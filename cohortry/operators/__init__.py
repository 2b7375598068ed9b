"""Operators on subject tables; each takes and returns DataFrames."""
