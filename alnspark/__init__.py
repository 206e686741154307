"""Alignment analytics expressed as Spark DataFrame plans."""
