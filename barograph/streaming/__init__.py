"""Structured Streaming forms of the bar and quality operators."""
