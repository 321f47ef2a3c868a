"""Coding-sequence design and analysis as Spark DataFrame plans."""
