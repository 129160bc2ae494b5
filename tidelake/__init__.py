"""A PySpark-native engine for time-stamped tables."""
