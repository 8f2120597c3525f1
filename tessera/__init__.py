"""Tessera: batch retrieval, evaluation and corpus analytics on Spark DataFrames."""
