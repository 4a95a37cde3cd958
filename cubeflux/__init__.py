"""Spectral-cube analytics on Spark: pixels are rows, spectra are arrays, operators are expressions, joins and aggregates."""
