"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` holds the entries that
the driver contract registers.
"""
