"""A Spark-native engine for typed analytical tables."""
