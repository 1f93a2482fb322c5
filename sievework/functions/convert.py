"""Strings to typed values, strictly: what isn't wholly a value of the type is an error, not null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Code points up to a space, as trimmed from both ends.
_EDGES = "".join(map(chr, range(0x21)))
#: Letters that Java takes for the type of a number at its end.
_LETTERS = ("d", "D", "f", "F", "l", "L")
_NUMERIC = (S.IntegerType, S.LongType, S.FloatType, S.DoubleType)


@dataclass(frozen=True)
class TrimConfig:
    """Which strings are trimmed before they are read. Strings themselves stay as they are."""

    trim_numerics: bool = True
    trim_booleans: bool = True


def trimmed(v: Column) -> Column:
    return F.btrim(v, F.lit(_EDGES))


def _ends_in_letter(v: Column) -> Column:
    return F.right(v, F.lit(1)).isin(*_LETTERS)


def ltrim(v: Column) -> Column:
    """Without white space of any kind on the left."""
    return F.regexp_replace(v, r"^\s+", "")


def rtrim(v: Column) -> Column:
    return F.regexp_replace(v, r"\s+$", "")


def text_to_double(v: Column) -> Column:
    """A double, or null: no type letter at the end, no short names of infinity, no blanks inside."""
    word = F.upper(F.ltrim(v, F.lit("+-")))
    odd = _ends_in_letter(v) | word.isin("INF", "INFINITY", "NAN") & ~F.ltrim(v, F.lit("+-")).isin("Infinity", "NaN")
    return F.when(odd | (trimmed(v) != v), None).otherwise(v.try_cast("double"))


def text_to(v: Column, kind: S.DataType) -> Column:
    """v, trimmed or not, as kind, or null where it isn't one."""
    if isinstance(kind, (S.IntegerType, S.LongType)):
        return F.when(v.rlike(r"^[+-]?[0-9]+$"), v.try_cast(kind.simpleString()))
    if isinstance(kind, S.DoubleType):
        return text_to_double(v)
    if isinstance(kind, S.FloatType):
        return text_to_double(v).cast("float")
    if isinstance(kind, S.BooleanType):
        return F.when(F.lower(v) == "true", True).when(F.lower(v) == "false", False)
    if isinstance(kind, S.StringType):
        return v
    return F.lit(None)


def convert(v: Column, name: str, kind: S.DataType, config: TrimConfig | None = None, nullable: bool = True) -> tuple[Column, Column]:
    """(value, error) of string v for field name; blank numbers and booleans are null without an error.

    The messages are fixed: they are part of what is written to error records.
    """
    config = config or TrimConfig()
    trim = config.trim_numerics if isinstance(kind, _NUMERIC) else config.trim_booleans if isinstance(kind, S.BooleanType) else False
    read = trimmed(v) if trim else v
    type_name = type(kind).__name__
    null_error = F.lit(None) if nullable else F.when(v.isNull(), "attempt to store null value into a field that is non-nullable")
    if isinstance(kind, S.StringType):
        return v, null_error.cast("string")
    value = text_to(read, kind)
    could_not = F.concat(F.lit("could not convert value '"), v, F.lit(f"' in field '{name}' to a '{type_name}'."))
    if isinstance(kind, S.NullType):
        return F.lit(None), F.when(v.isNotNull(), could_not)
    error = F.when(v.isNotNull() & (trimmed(v) != "") & value.isNull(), could_not)
    if isinstance(kind, _NUMERIC):
        letters = F.concat(F.lit("can't convert '"), v, F.lit(f"' in field '{name}' to {type_name} type. (No alphanumeric characters are allowed in numeric fields.)"))
        error = F.when(_ends_in_letter(trimmed(v)), letters).otherwise(error)
    return value, F.coalesce(null_error, error).cast("string")


def is_numeric(v: Column) -> Column:
    """Digits of any length with an optional sign; null and blank are not."""
    return F.coalesce(v.rlike(r"^[+-]?[0-9]+$"), F.lit(False))
