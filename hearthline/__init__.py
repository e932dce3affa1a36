"""A Spark-native engine for rental listings and large text tables."""
