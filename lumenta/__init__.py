"""A Spark-native engine for media catalogs."""
