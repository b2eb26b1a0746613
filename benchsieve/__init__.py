"""Benchmark-audit analytics as Spark DataFrame operators."""
