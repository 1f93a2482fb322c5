"""Addresses of values: "$location.name", or a bare name with the caller's location."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..errors import ConfigError

CONSTANT, INPUT, ENRICHED, SCRATCHPAD, ENRICHED_THEN_INPUT = "constant", "input", "enriched", "scratchpad", "enriched-then-input"
LOCATIONS = (CONSTANT, INPUT, ENRICHED, SCRATCHPAD, ENRICHED_THEN_INPUT)


@dataclass(frozen=True)
class Source:
    location: str
    name: str

    @staticmethod
    def parse(text: Any, default: str = ENRICHED_THEN_INPUT) -> Source:
        if not isinstance(text, str) or not text.strip():
            raise ConfigError("a field needs a name")
        text = text.strip()
        if not text.startswith("$"):
            return Source(default, text)
        location, dot, name = text[1:].partition(".")
        if not dot or "." in name or not name or location not in LOCATIONS:
            raise ConfigError(f"no such field address: {text!r}")
        return Source(location, name)


def location(text: Any, default: str) -> str:
    if text is None:
        return default
    if text not in LOCATIONS:
        raise ConfigError(f"no such location: {text!r}")
    return text
