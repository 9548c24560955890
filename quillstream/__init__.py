"""Marker resolution analytics on Spark: short noisy texts on pages, resolved against a list of valid identifiers."""

__version__ = "1.0.0"
