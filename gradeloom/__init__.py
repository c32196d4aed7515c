"""Gradebook analytics as Spark DataFrame operators."""
