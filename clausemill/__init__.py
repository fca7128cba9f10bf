"""Clause analytics on Spark: canonical text, clauses, rule findings, verified quotes."""
