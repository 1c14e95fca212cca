"""Spark-native document retrieval and corpus preparation."""
