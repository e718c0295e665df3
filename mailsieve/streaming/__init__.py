"""Structured Streaming jobs over a mail drop folder."""
