"""Spark-native retrieval analytics over document knowledge bases."""
