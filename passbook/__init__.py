"""Passbook: ledger analytics, message and token extraction as Spark jobs."""
