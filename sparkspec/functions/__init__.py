"""Scalar functions: chemistry, text, geometry and spectra."""
