"""Operators over DataFrames of spectra, compositions, clusters, standards and particles."""
