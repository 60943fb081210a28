"""Spark-native k-mer dictionary and sequence-query engine."""
