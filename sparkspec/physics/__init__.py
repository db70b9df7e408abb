"""Numerical cores that run per spectrum inside Arrow UDFs."""
