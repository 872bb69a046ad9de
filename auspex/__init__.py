"""A Spark-native source-threat analytics engine."""
