"""Curated clinical-genomics analytics on Spark DataFrames."""
