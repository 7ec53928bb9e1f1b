"""Operators over DataFrames: quality, reconciliation, finance, layers, catalog, compliance."""
