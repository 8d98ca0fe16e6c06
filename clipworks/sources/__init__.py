"""Readers, writers, schemas and the views over the driver tables."""
