"""Operators for preparing training text: counting, filtering, deduplicating and encoding documents."""
