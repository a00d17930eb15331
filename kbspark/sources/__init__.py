"""Readers of files, documents and tables."""
