"""Compositions of operators: consume, produce, fetch, publish, reprocess."""
