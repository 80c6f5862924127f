"""Structured Streaming intake of new recordings."""
