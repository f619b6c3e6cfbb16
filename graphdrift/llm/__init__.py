"""Operators for large training-data corpora, each a Spark job over a documents (or vectors) table."""
