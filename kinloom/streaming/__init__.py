"""Structured Streaming fronts of the stateless curation operators."""
