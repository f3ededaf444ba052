"""Spatio-temporal cube analytics on Spark: sources, functions, operators, plans and streaming."""
