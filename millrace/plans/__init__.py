"""Composed plans: the driver queries and the end-to-end pipeline."""
