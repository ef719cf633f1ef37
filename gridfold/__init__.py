"""Geospatial feature analytics as ordinary PySpark DataFrame plans."""
