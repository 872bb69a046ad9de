"""Structured Streaming over scan events."""
