"""A PySpark engine for spectral composition analytics."""
