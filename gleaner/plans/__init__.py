"""Composed plans and the named queries."""
