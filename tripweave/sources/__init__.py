"""Readers: text layouts and stored tables."""
