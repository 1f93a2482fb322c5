"""Enriched records to typed columns, and what can't be converted to error records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..engine import AUTO_COPIED
from ..functions.convert import TrimConfig, convert
from ..functions.schema import Schema
from .frame import Outcome

#: The key under which an error record lists what was wrong with its values.
TYPE_ERROR = "__sievework_type_error__"


def keys_of(enriched: DataFrame) -> list[str]:
    """All keys of a column enriched, sorted: a sum by key, so as many rows as there are keys reach the driver."""
    rows = enriched.select(F.explode(F.map_keys("enriched")).alias("k")).distinct()
    return sorted(r["k"] for r in rows.collect())


def auto_copied_keys(enriched: DataFrame) -> set[str]:
    names = F.explode(F.split(F.element_at("enriched", F.lit(AUTO_COPIED)), ","))
    return {r["k"] for r in enriched.select(names.alias("k")).distinct().collect()}


def to_string_columns(enriched: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A string column for each key, null where a record has none; without keys, for all that occur."""
    keys = keys_of(enriched) if keys is None else keys
    return enriched.select(*[F.element_at("enriched", F.lit(k)).alias(k) for k in keys])


def to_typed(enriched: DataFrame, schema: Schema, trim: TrimConfig | None = None, add_missing: bool = True, type_auto_copied: bool = False) -> Outcome:
    """Typed columns of the schema, and records with a value that can't be converted, as maps.

    Blank numbers and booleans are null and get the default later; every column
    may be null here. Fields that some record has by auto-copy stay strings,
    unless type_auto_copied says otherwise, which also saves a pass over the
    data. Without add_missing, only keys that occur become columns.
    """
    copied = set() if type_auto_copied else auto_copied_keys(enriched)
    seen = None if add_missing else set(keys_of(enriched))
    values, errors = [], []
    for f in schema.fields:
        if seen is not None and f.name not in seen:
            continue
        raw = F.element_at("enriched", F.lit(f.name))
        value, error = convert(raw, f.name, S.StringType() if f.name in copied else f.type, trim)
        values.append(value.alias(f.name))
        if not isinstance(f.type, S.StringType) and f.name not in copied:
            errors.append(error)
    rows = _evaluated(enriched, values, errors)
    bad = F.map_concat(F.map_filter("enriched", lambda k, _: k != TYPE_ERROR), F.create_map(F.lit(TYPE_ERROR), F.col("__typed.error")))
    return Outcome(rows.filter("__typed.error = ''").select("__typed.row.*"), rows.filter("__typed.error != ''").select(bad.alias("enriched")))


def _evaluated(df: DataFrame, values: list[Column], errors: list[Column]) -> DataFrame:
    """df with __typed: values as row, and all errors in one text.

    An explode of one element stands between the two, so that a filter on the
    errors is not pushed below what the values are made of, where all of it
    would be written out, and run, once for each time that it is referred to.
    """
    message = F.concat_ws("; ", *errors) if errors else F.lit("")
    row = F.struct(*values) if values else F.struct(F.lit(None).alias("__none"))
    return df.select("*", F.explode(F.array(F.struct(row.alias("row"), message.alias("error")))).alias("__typed"))


def columns_to_typed(df: DataFrame, schema: Schema, trim: TrimConfig | None = None) -> Outcome:
    """to_typed() for string columns: error rows are df's with the message in TYPE_ERROR."""
    values, errors = [], []
    for f in schema.fields:
        raw = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string")
        value, error = convert(raw, f.name, f.type, trim)
        values.append(value.alias(f.name))
        if not isinstance(f.type, S.StringType):
            errors.append(error)
    rows = _evaluated(df, values, errors)
    return Outcome(rows.filter("__typed.error = ''").select("__typed.row.*"), rows.filter("__typed.error != ''").select(*[F.col(f"`{c}`") for c in df.columns], F.col("__typed.error").alias(TYPE_ERROR)))
