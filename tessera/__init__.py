"""A PySpark-native graph and record analytics engine."""
