"""Structured Streaming entry points (the reference itself has no streams)."""
