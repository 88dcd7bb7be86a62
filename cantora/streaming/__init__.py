"""Structured Streaming variants of ordered operators."""
