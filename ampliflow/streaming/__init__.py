"""Structured Streaming forms of the associative operators."""
