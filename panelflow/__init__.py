"""Drift-tolerant analysis panels as Spark DataFrame operators."""
