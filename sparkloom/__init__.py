"""Corpus analytics and retrieval as Spark DataFrame operators."""
