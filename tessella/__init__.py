"""Spark-native engine for understanding software projects and text corpora as data."""
