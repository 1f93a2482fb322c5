"""Schemas and column functions."""
