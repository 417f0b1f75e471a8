"""Tabular study operators as Spark DataFrame transformations."""
