"""A configuration as a tree of actions, checked before any row is read.

config := {"global"?: {"exceptionHandlingList"?: [action]}, "items"?: [item]}
item   := {"name"?: string, "actions": [action]+}
action := {"actionType": string, "config"?: object or array}

Keys that mean nothing to an action are left alone. An object that stands alone
in an array is taken as the object.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from ..errors import ConfigError
from . import source as A
from .source import Source

UNARY = ("empty", "not-empty", "non-empty", "numeric", "non-numeric", "null", "non-null")


#: A predicate over the slots of one or two fields (the second is None for one): a column or a bool; null counts as false.
Checker = Callable[[Any, Any], Any]


@dataclass(frozen=True)
class Node:
    """Base of all actions."""

    def branches(self) -> tuple[Sequence[Node], ...]:
        return ()


@dataclass(frozen=True)
class AddFields(Node):
    pairs: tuple[tuple[str, str | None], ...]


@dataclass(frozen=True)
class AddRejectionReason(Node):
    field: str


@dataclass(frozen=True)
class AddScratch(Node):
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Copy(Node):
    pairs: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class SimpleCopy(Node):
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Check(Node):
    op: str
    left: Source
    right: Source | None
    case_sensitive: bool
    explicit: bool
    on_pass: tuple[Node, ...]
    on_fail: tuple[Node, ...]
    #: A predicate of the user's, for an op that isn't built in.
    test: Checker | None = None

    def branches(self):
        return self.on_pass, self.on_fail


@dataclass(frozen=True)
class Lookup(Node):
    select: tuple[str, ...]
    table: str
    file: str | None
    where: str
    equals: str
    on_pass: tuple[Node, ...]
    on_fail: tuple[Node, ...]

    def branches(self):
        return self.on_pass, self.on_fail


@dataclass(frozen=True)
class JdbcLookup(Node):
    client: str
    select: tuple[str, ...]
    table: str
    #: Columns that must equal a value, where the condition is no more than that.
    keys: tuple[tuple[str, Source], ...]
    #: Any other condition: SQL over the table's columns in which {i} stands for the i-th of values.
    condition: str | None
    values: tuple[Source, ...]
    on_pass: tuple[Node, ...]
    on_fail: tuple[Node, ...]

    def branches(self):
        return self.on_pass, self.on_fail


@dataclass(frozen=True)
class Nothing(Node):
    name: str = ""


@dataclass(frozen=True)
class Reject(Node):
    reason: str | None
    reason_from: str | None
    stop: bool


@dataclass(frozen=True)
class ReplaceNull(Node):
    fields: tuple[Source, ...]
    value: str
    output: str


@dataclass(frozen=True)
class SearchReplace(Node):
    fields: tuple[str, ...]
    search: str
    replace: str


@dataclass(frozen=True)
class Custom(Node):
    """An action of the user's: apply(state, guard) returns the state after it, in columns."""

    apply: Callable[[Any, Any], Any]
    reads: tuple[str, ...] = ()


#: Makes an action of (actionType, config), or None for what it doesn't know; asked before the built-in ones.
Creator = Callable[[str, Any], Node | None]


@dataclass(frozen=True)
class Item:
    name: str
    actions: tuple[Node, ...]


@dataclass(frozen=True)
class Program:
    items: tuple[Item, ...]
    on_error: tuple[Node, ...] = ()
    nodes: tuple[Node, ...] = field(default=(), compare=False)


def _text(node: dict, key: str, what: str) -> str:
    value = node.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"{what}: {key!r} must be a string with something in it")
    return value


def _texts(value: Any, what: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not value or not all(isinstance(x, str) and x.strip() for x in value):
        raise ConfigError(f"{what} must be a list of strings with something in them")
    return tuple(x.strip() for x in value)


def _flag(node: dict, key: str, default: bool, what: str) -> bool:
    value = node.get(key, default)
    if not isinstance(value, bool):
        raise ConfigError(f"{what}: {key!r} must be true or false")
    return value


def _object(config: Any, what: str) -> dict:
    if isinstance(config, list) and len(config) == 1:
        config = config[0]
    if not isinstance(config, dict):
        raise ConfigError(f"{what} needs a configuration object")
    return config


def _where(where: str, what: str) -> tuple[tuple[tuple[str, Source], ...], str | None, tuple[Source, ...]]:
    """Keys alone if the condition is column = 'value', joined by and; otherwise the condition with its values taken out."""
    parts = [re.fullmatch(r"\s*([A-Za-z_][\w.]*)\s*=\s*'([^']*)'\s*", x) for x in re.split(r"(?i)\s+and\s+", where)]
    if all(parts):
        return tuple((m[1], Source.parse(m[2], A.CONSTANT)) for m in parts if m), None, ()
    values: list[Source] = []

    def taken(m: re.Match) -> str:
        values.append(Source.parse(m[1] or m[2]))
        return f"{{{len(values) - 1}}}"

    condition = re.sub(r"'(\$\w+\.[^'.]+)'|(\$\w+\.\w+)", taken, where.replace("{", "{{").replace("}", "}}"))
    if not values:
        raise ConfigError(f"{what}: where must refer to a value of the record, as in column = '$location.field': {where!r}")
    return (), condition, tuple(values)


class Parser:
    def __init__(self, creators: Sequence[Creator] = (), checkers: Mapping[str, Checker] | None = None) -> None:
        self.creators, self.checkers = creators, checkers or {}
        self.built_in: dict[str, Callable[[Any, str], Node]] = {
            "add-enriched-field": self._add_fields,
            "add-enriched-fields": self._add_fields,
            "add-rejection-reason": lambda c, t: AddRejectionReason(_text(_object(c, t), "field", t)),
            "add-scratch-to-enriched": lambda c, t: AddScratch(_texts(_object(c, t).get("fields"), t)),
            "copy": self._copy,
            "simple-copy": lambda c, t: SimpleCopy(_texts(_object(c, t).get("inputSource"), t)),
            "check": self._check,
            "lookup": self._lookup,
            "jdbc-lookup": self._jdbc,
            "null": lambda c, t: Nothing(str((_object(c, t) if c else {}).get("name", ""))),
            "reject": self._reject,
            "replace-null": self._replace_null,
            "search-and-replace": self._search,
        }

    def program(self, config: str | dict) -> Program:
        root = json.loads(config) if isinstance(config, str) else config
        if not isinstance(root, dict):
            raise ConfigError("a configuration is an object")
        items = []
        for node in root.get("items") or []:
            actions = self.actions(node.get("actions") if isinstance(node, dict) else None)
            if not actions:
                raise ConfigError("an item needs a list of actions")
            items.append(Item(str(node.get("name", "")), actions))
        on_error = self.actions((root.get("global") or {}).get("exceptionHandlingList"))
        everything: list[Node] = []

        def walk(nodes: Sequence[Node]) -> None:
            for n in nodes:
                everything.append(n)
                for branch in n.branches():
                    walk(branch)

        for item in items:
            walk(item.actions)
        walk(on_error)
        return Program(tuple(items), on_error, tuple(everything))

    def actions(self, nodes: Any) -> tuple[Node, ...]:
        if nodes is None:
            return ()
        if not isinstance(nodes, list):
            raise ConfigError("actions are a list")
        return tuple(self.action(n) for n in nodes)

    def action(self, node: Any) -> Node:
        if not isinstance(node, dict):
            raise ConfigError("an action is an object")
        kind = _text(node, "actionType", "an action").strip()
        config = node.get("config")
        for make in self.creators:
            if (made := make(kind, config)) is not None:
                return made
        if kind not in self.built_in:
            raise ConfigError(f"no such action: {kind!r}")
        return self.built_in[kind](config, kind)

    def _branches(self, c: dict, what: str, needed: bool) -> tuple[tuple[Node, ...], tuple[Node, ...]]:
        both = self.actions(c.get("onPass")), self.actions(c.get("onFail"))
        if needed and not any(both):
            raise ConfigError(f"{what} needs an action in onPass or onFail")
        return both

    def _add_fields(self, c: Any, what: str) -> Node:
        nodes = c if isinstance(c, list) else [c]
        if not nodes or not all(isinstance(n, dict) for n in nodes):
            raise ConfigError(f"{what} needs a list of keys and values")
        pairs = {_text(n, "key", what): None if n.get("value") is None else n["value"] if isinstance(n["value"], str) else json.dumps(n["value"]) for n in nodes}
        return AddFields(tuple(pairs.items()))

    def _copy(self, c: Any, what: str) -> Node:
        nodes = c.get("config") if isinstance(c, dict) and "config" in c else c
        nodes = nodes if isinstance(nodes, list) else [nodes]
        if not nodes or not all(isinstance(n, dict) for n in nodes):
            raise ConfigError(f"{what} needs a list of sources and targets")
        return Copy(tuple((_text(n, "inputSource", what), _text(n, "outputTarget", what)) for n in nodes))

    def _check(self, c: Any, what: str) -> Node:
        c = _object(c, what)
        op = _text(c, "op", what).strip()
        left = c.get("left", c.get("field"))
        side = c.get("leftSource", c.get("fieldSource"))
        explicit = side is not None or isinstance(left, str) and left.startswith("$")
        one = Source.parse(left, A.location(side, A.ENRICHED_THEN_INPUT))
        on_pass, on_fail = self._branches(c, what, True)
        if op in self.checkers:
            right = c.get("right")
            other = None if right is None else Source.parse(right, A.location(c.get("rightSource"), A.ENRICHED_THEN_INPUT))
            return Check(op, one, other, _flag(c, "caseSensitive", True, what), explicit, on_pass, on_fail, self.checkers[op])
        if c.get("right") is None:
            if op not in UNARY:
                raise ConfigError(f"{what}: no such op for one field: {op!r}")
            return Check(op, one, None, True, explicit, on_pass, on_fail)
        if op != "equals":
            raise ConfigError(f"{what}: no such op for two fields: {op!r}")
        other = Source.parse(c["right"], A.location(c.get("rightSource"), A.ENRICHED_THEN_INPUT))
        return Check(op, one, other, _flag(c, "caseSensitive", True, what), explicit, on_pass, on_fail)

    def _lookup(self, c: Any, what: str) -> Node:
        c = _object(c, what)
        on_pass, on_fail = self._branches(c, what, False)
        file = c.get("fromFile")
        return Lookup(_texts(c.get("select"), what), _text(c, "fromDBTable", what), file if isinstance(file, str) and file.strip() else None, _text(c, "where", what), _text(c, "equals", what), on_pass, on_fail)

    def _jdbc(self, c: Any, what: str) -> Node:
        c = _object(c, what)
        where = _text(c, "where", what).strip()
        on_pass, on_fail = self._branches(c, what, True)
        keys, condition, values = _where(where, what)
        return JdbcLookup(_text(c, "jdbcClient", what), _texts(c.get("select"), what), _text(c, "fromDBTable", what), keys, condition, values, on_pass, on_fail)

    def _reject(self, c: Any, what: str) -> Node:
        c = _object(c, what)
        if ("reason" in c) == ("reasonFrom" in c):
            raise ConfigError(f"{what} needs either a reason or reasonFrom")
        reason = _text(c, "reason", what) if "reason" in c else None
        return Reject(reason, None if reason else _text(c, "reasonFrom", what), _flag(c, "stopProcessingActionList", True, what))

    def _replace_null(self, c: Any, what: str) -> Node:
        c = _object(c, what)
        if ("field" in c) == ("fields" in c):
            raise ConfigError(f"{what} needs either a field or fields")
        names = (_text(c, "field", what),) if "field" in c else _texts(c["fields"], what)
        output = c.get("outputTo", A.ENRICHED)
        if output not in (A.ENRICHED, A.SCRATCHPAD):
            raise ConfigError(f"{what}: can't write to {output!r}")
        return ReplaceNull(tuple(Source.parse(n) for n in names), _text(c, "newValue", what), output)

    def _search(self, c: Any, what: str) -> Node:
        c = _object(c, what)
        for key in ("searchFor", "replaceWith"):
            if not isinstance(c.get(key), str) or not c[key]:
                raise ConfigError(f"{what}: {key!r} must not be empty")
        return SearchReplace(_texts(c.get("inputSource"), what), c["searchFor"], c["replaceWith"])


def parse(config: str | dict, creators: Sequence[Creator] = (), checkers: Mapping[str, Checker] | None = None) -> Program:
    return Parser(creators, checkers).program(config)
