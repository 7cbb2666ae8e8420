"""Spark-first text normalisation and corpus preparation."""
