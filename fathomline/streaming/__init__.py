"""Streaming forms of the first panel steps."""
