"""Structured Streaming front of the read query."""
