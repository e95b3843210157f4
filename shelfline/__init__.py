"""Retail and operations analytics as lazy PySpark DataFrame operators."""
