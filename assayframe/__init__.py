"""Spark-native analytics of classifier confidence, and training-data operators."""
