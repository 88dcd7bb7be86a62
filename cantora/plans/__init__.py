"""Queries built from the operators, and the same in SQL."""
