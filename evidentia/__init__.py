"""A PySpark-native engine for hybrid retrieval and evidence-backed graph analytics."""

__version__ = "0.1.0"
