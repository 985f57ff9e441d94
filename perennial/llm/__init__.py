"""Operators for preparing large text collections.  Nothing outside this package imports it."""
