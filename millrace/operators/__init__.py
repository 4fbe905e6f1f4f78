"""Relational operators over interaction logs, embeddings and keyed tables."""
