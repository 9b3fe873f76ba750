"""A PySpark-native engine for indexing, searching, evaluating and cleaning text collections."""

__version__ = "0.1.0"
