"""What goes wrong before any row is read."""


class ConfigError(ValueError):
    """A configuration or schema that can't be run."""
