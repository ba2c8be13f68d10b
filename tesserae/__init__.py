"""tesserae: Spark-native block compression, caching, scanning and measurement of dense numeric data."""

__version__ = "0.1.0"
