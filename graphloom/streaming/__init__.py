"""Streaming of the knowledge-graph engine."""
