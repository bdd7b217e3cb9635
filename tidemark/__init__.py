"""A Spark-native analytics engine for media catalogues."""
