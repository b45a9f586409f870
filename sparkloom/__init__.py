"""Retrieval, evaluation and corpus analytics on PySpark."""
