"""tessera: Spark-native statistics for grouped, position-indexed tables."""
