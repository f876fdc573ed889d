"""quire: a PySpark-native engine for technical-document collections."""

__version__ = "0.1.0"
