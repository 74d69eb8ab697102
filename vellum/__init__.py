"""Spark-native analytics over versioned text documents and the rules that govern them."""
