"""A PySpark-native engine for versioned tables and column analytics."""
