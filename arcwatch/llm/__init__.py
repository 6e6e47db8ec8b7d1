"""Operators for building large training corpora, each on Spark DataFrames."""
