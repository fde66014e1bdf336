"""Spark-native engine for environmental-DNA metabarcoding data and training-data preparation."""
