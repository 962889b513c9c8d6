"""Incremental maintenance of stored results, usable from ``foreachBatch``."""
