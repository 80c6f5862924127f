"""Spoken-transcript analytics as Spark DataFrame operators."""
