"""Structured Streaming forms of the change rules."""
