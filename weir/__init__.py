"""PySpark-native analytics engine."""
