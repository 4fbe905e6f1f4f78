"""Readers, writers and the synthetic event source."""
