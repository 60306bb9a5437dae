"""A PySpark-native engine for mapping and counting sequences."""
