"""Detectors, joins and correlation over DataFrames."""
