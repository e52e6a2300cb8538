"""Structured Streaming forms of the event feeds."""
