"""Structured Streaming jobs over the audit, upload and translation tables."""
