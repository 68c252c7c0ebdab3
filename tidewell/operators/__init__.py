"""Relational operators of the engine. Each takes and returns DataFrames."""
