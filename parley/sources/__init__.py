"""Readers for per-session JSON artifacts and the tables written back."""
