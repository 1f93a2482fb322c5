"""Output schemas written as Avro JSON: ordered fields with a type, nullability and a default."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as S

from ..errors import ConfigError

#: The types a field may have.
TYPES: dict[str, S.DataType] = {"string": S.StringType(), "int": S.IntegerType(), "long": S.LongType(), "float": S.FloatType(), "double": S.DoubleType(), "boolean": S.BooleanType(), "null": S.NullType()}
MISSING = object()


def type_of(name: str) -> S.DataType:
    if name not in TYPES:
        raise ConfigError(f"no such field type: {name!r}")
    return TYPES[name]


def _fits(default: Any, kind: S.DataType, nullable: bool) -> bool:
    if default is None:
        return nullable or isinstance(kind, S.NullType)
    if isinstance(default, bool):
        return isinstance(kind, S.BooleanType)
    if isinstance(default, int):
        return isinstance(kind, (S.IntegerType, S.LongType))
    if isinstance(default, float):
        return isinstance(kind, (S.FloatType, S.DoubleType))
    return isinstance(default, str) and isinstance(kind, S.StringType)


@dataclass(frozen=True)
class Field:
    """A field and its default, which must be of the field's own JSON kind: 0 is no default of a double, 0.0 is."""

    name: str
    type: S.DataType
    nullable: bool
    default: Any
    doc: str = ""

    def __post_init__(self) -> None:
        if not self.name or not self.name.strip():
            raise ConfigError("a field needs a name")
        if self.default is MISSING:
            raise ConfigError(f"field {self.name!r} needs a default")
        if not _fits(self.default, self.type, self.nullable):
            raise ConfigError(f"default {self.default!r} does not fit field {self.name!r} of type {self.type.simpleString()}")

    @staticmethod
    def from_json(node: dict) -> Field:
        raw = node.get("type", MISSING)
        members = raw if isinstance(raw, list) else [raw]
        if raw is MISSING or not members or not all(isinstance(m, str) for m in members):
            raise ConfigError(f"field {node.get('name')!r} needs a type name or a list of them")
        solid = [m for m in members if m != "null"]
        if len(solid) > 1:
            raise ConfigError(f"field {node.get('name')!r} has more than one type besides null")
        return Field(str(node.get("name") or ""), type_of(solid[0] if solid else "null"), "null" in members, node.get("default", MISSING), str(node.get("doc", "")))

    def to_json(self) -> dict:
        name = next(k for k, v in TYPES.items() if v == self.type)
        out: dict[str, Any] = {"name": self.name, "type": ["null", name] if self.nullable and name != "null" else [name]}
        if self.doc:
            out["doc"] = self.doc
        return out | {"default": self.default}

    def struct_field(self) -> S.StructField:
        return S.StructField(self.name, self.type, self.nullable, {"default": self.default} if self.default is not None else None)

    def default_as(self, kind: type) -> Any:
        """The default, which must be of this Python type or null."""
        if self.default is not None and not isinstance(self.default, kind):
            raise ConfigError(f"the default of field {self.name!r} is no {kind.__name__}")
        return self.default

    def default_text(self) -> str | None:
        if self.default is None:
            return None
        return str(self.default).lower() if isinstance(self.default, bool) else str(self.default)

    def as_string(self, force_nullable: bool = False) -> Field:
        """The field as a string with its default in words; a null default stays and makes it nullable."""
        nullable = force_nullable or self.nullable or self.default is None
        return Field(self.name, S.StringType(), nullable, self.default_text(), self.doc)


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    namespace: str = ""

    @staticmethod
    def parse(text: str, for_output: bool = False) -> Schema:
        """From Avro JSON; for_output also turns away float and null-only fields, which can't be written."""
        node = json.loads(text)
        if not isinstance(node, dict) or not isinstance(node.get("fields"), list):
            raise ConfigError("a schema needs a list of fields")
        out = Schema(str(node.get("name", "record")), tuple(Field.from_json(f) for f in node["fields"]), str(node.get("namespace", "")))
        names = [f.name for f in out.fields]
        if len(set(names)) < len(names):
            raise ConfigError("a schema names a field twice")
        if for_output:
            out.check_output()
        return out

    def check_output(self) -> None:
        for f in self.fields:
            if isinstance(f.type, (S.FloatType, S.NullType)):
                raise ConfigError(f"field {f.name!r}: an output field can't be {f.type.simpleString()}")

    def struct_type(self) -> S.StructType:
        return S.StructType([f.struct_field() for f in self.fields])

    def to_json(self) -> str:
        head = {"type": "record", "name": self.name} | ({"namespace": self.namespace} if self.namespace else {})
        return json.dumps(head | {"fields": [f.to_json() for f in self.fields]})

    def as_strings(self, force_nullable: bool = False) -> Schema:
        return Schema(self.name, tuple(f.as_string(force_nullable) for f in self.fields), self.namespace)

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


def load_schema(spark, path: str, for_output: bool = True) -> Schema:
    """A schema file, by any path that Spark reads."""
    return Schema.parse(spark.read.text(path, wholetext=True).first()["value"], for_output)


def stringify_schema_json(text: str) -> str:
    """Avro JSON to Avro JSON with every type but null a string and every default its text; a null default needs a nullable field."""
    node = json.loads(text)
    for f in node["fields"]:
        one = isinstance(f["type"], str)
        members = [f["type"]] if one else f["type"]
        changed = list(dict.fromkeys(m if m == "null" else "string" for m in members))
        default = f.get("default", MISSING)
        if default is MISSING or default is None and "null" not in members:
            raise ConfigError(f"field {f.get('name')!r} needs a default that it can hold")
        f["type"] = changed[0] if one else changed
        f["default"] = None if default is None else str(default).lower() if isinstance(default, bool) else str(default)
    return json.dumps(node)


def stringify_schema_file(source: str, target: str) -> None:
    with open(source) as f:
        text = stringify_schema_json(f.read())
    with open(target, "w") as f:
        f.write(text)


def all_string_struct(schema: S.StructType, force_nullable: bool = True) -> S.StructType:
    """A struct with every field a string; defaults in the metadata become text."""

    def meta(f: S.StructField) -> dict | None:
        m = dict(f.metadata or {})
        if "default" in m:
            m["default"] = str(m["default"]).lower() if isinstance(m["default"], bool) else str(m["default"])
        return m or None

    return S.StructType([S.StructField(f.name, S.StringType(), f.nullable or force_nullable, meta(f)) for f in schema.fields])


def struct_from(fields: Iterable[Field]) -> S.StructType:
    return S.StructType([f.struct_field() for f in fields])


def field_is_null(row: Row, name: str) -> bool:
    """Whether a row has no such field or null in it."""
    return name not in row.__fields__ or row[name] is None
