"""Spark-first analytics over aligned reads, variant evidence and sample-by-marker matrices."""
