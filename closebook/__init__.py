"""Ledger, payables and people data moved into a lake with Spark, and proved right."""
