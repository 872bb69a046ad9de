"""Corpus views and file readers."""
