"""Spark-native retrieval analytics: text, chunking, search, evaluation and statistics as DataFrames."""
