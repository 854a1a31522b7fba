"""A PySpark-native analytics engine: operator library, SQL dialect, versioned tables."""

__version__ = "0.1.0"
