"""Column expressions: canonical text, hashing, coercion, positions."""
