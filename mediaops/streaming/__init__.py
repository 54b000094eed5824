"""Structured Streaming forms of the one-pass operators."""
