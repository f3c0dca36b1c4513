"""Temporal event analytics as Spark DataFrame transformations."""
