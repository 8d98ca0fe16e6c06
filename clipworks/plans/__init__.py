"""Registered queries and their SQL oracles, grouped by subject."""
