"""Interferometric analytics as Spark DataFrame operators."""
