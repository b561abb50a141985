"""tessera: a Spark-native analytics engine for measurement tables."""
