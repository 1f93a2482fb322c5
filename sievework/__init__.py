"""Configuration-driven record validation and enrichment, compiled to Spark plans."""

__version__ = "0.1.0"
