"""Bitemporal graph memory on PySpark: facts, entities and episodes as DataFrames with full history."""
