"""Retrieval, ranking and evaluation analytics as Spark DataFrame plans."""
