"""Spark-native text retrieval, lexical statistics and corpus analytics."""
