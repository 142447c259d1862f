"""Composed pipelines and the query registry."""
