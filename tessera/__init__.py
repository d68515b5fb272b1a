"""Tessera: token-sequence corpus analytics as composable Spark DataFrames."""
