"""Quernstone: evaluation analytics for generated code, on Spark DataFrames."""
