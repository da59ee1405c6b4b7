"""Scalar column expressions and sequence functions."""
