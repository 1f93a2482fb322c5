"""Small text files on the driver, as for configurations."""

from __future__ import annotations

import tempfile
from pathlib import Path


def file_to_string(path: str) -> str:
    """A file's text without its line ends."""
    return "".join(Path(path).read_text().splitlines())


def write_file(text: str, path: str) -> str:
    """Write or overwrite a file; returns its path."""
    Path(path).write_text(text)
    return path


def write_temp_file(text: str, suffix: str = ".json") -> str:
    """A new file, left to the caller to remove."""
    with tempfile.NamedTemporaryFile("w", suffix=suffix, delete=False) as f:
        f.write(text)
    return f.name
