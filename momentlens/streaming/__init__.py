"""Structured Streaming variants of the interval and index operators."""
