"""Whole analyses, and the queries of the driver contract."""
