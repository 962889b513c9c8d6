"""Operators for preparing training data: near copies, scoring, archives, filters and tokens."""
