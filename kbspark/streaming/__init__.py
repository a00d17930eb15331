"""Incremental maintenance as streams."""
