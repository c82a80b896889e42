"""Spark-native analytics over document archives, entity networks and retrieval corpora."""
