"""Configurations, compiled to column expressions and joins."""
