"""Catalogue data-quality engine on Spark DataFrames."""
