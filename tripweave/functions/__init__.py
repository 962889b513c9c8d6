"""Column expressions (array paths, hashing, geometry, grid cells)."""
