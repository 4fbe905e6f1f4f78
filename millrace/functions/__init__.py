"""Column functions: portable hashing, vectors, generator scalars."""
