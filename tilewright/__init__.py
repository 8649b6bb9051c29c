"""Tilewright: a PySpark-native analytics engine for hierarchical tile data."""

__version__ = "0.1.0"
