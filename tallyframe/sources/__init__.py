"""Readers, writers and the adapters that turn the star schema into canonical views."""
