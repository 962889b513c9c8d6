"""Whole jobs composed from the operators, each one lazy Spark plan for all keys at once."""
