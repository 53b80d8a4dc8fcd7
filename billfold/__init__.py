"""Billing documents to verified tables, as Spark DataFrame jobs."""
