"""Registered queries over the supplied tables, each with an equivalent DuckDB statement."""
