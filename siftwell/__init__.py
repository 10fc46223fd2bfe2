"""A Spark-native engine that selects, prepares and analyses training data."""
