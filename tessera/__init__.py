"""Tessera: object-store analytics expressed as Spark DataFrames."""
