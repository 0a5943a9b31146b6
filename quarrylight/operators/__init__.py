"""Relational, ranking, graph and versioning operators."""
