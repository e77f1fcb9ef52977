"""Readers of captures, logs and derived tables, and writers of results."""
