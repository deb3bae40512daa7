"""Spark-first analytics over sequences, intervals, graphs and pairings."""
