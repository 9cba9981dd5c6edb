"""Tiled point and polygon analytics on Spark: archives, tile algebra, filters, counts, densities, pyramids."""

__version__ = "0.1.0"
