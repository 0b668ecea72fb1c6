"""Readers of documents, listings and tables."""
