"""Spark-first analytics over corpora of graded work and training text."""
