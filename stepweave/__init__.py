"""Procedural-text analytics as Spark DataFrame transformations."""
