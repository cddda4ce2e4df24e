"""A PySpark-native analytics engine for property transactions."""
