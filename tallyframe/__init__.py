"""tallyframe: a PySpark-native engine for detection-and-classification event data."""

__version__ = "0.1.0"
