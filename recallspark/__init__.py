"""recallspark: a PySpark-native engine for evidence-preserving recall over conversation archives."""

__version__ = "0.1.0"
