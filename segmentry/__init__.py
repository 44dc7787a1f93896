"""Spark-native analytics over labelled intervals, sequences and training text."""
