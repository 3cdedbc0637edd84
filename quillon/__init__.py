"""A PySpark-native analytics engine: operators from DataFrame to DataFrame."""
