"""Operators put together, and the registered queries."""
