"""Operators of the knowledge-graph engine."""
