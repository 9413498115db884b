"""Spark-first document-retrieval analytics."""
