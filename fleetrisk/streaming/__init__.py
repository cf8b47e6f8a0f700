"""Structured Streaming forms of the live results."""
