"""Acquisition as a micro-batch stream."""
