"""Readers and writers for prices, filings, identifier lists and result tables."""
