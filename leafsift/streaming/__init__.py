"""Structured Streaming jobs over the event log and the page store."""
