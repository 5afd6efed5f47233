"""Structured Streaming variants of the periodic jobs."""
