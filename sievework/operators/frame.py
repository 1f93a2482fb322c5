"""Helpers over DataFrames: schemas, defaults, splits and unions, each one projection or filter."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import ConfigError
from ..functions.convert import is_numeric
from ..functions.schema import Field, Schema

#: The column in which change_schema() puts what it could not convert.
CHANGE_ERROR = "__sievework_change_schema_error__"


class Split(NamedTuple):
    positive: DataFrame
    negative: DataFrame


class Outcome(NamedTuple):
    """What has gone well, and the rest, as strings with the reasons."""

    good: DataFrame
    errors: DataFrame

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Outcome:
        return Outcome(self.good.persist(level), self.errors.persist(level))

    def unpersist(self) -> Outcome:
        return Outcome(self.good.unpersist(), self.errors.unpersist())


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def split(df: DataFrame, condition: Column) -> Split:
    """Rows that meet a condition, and rows that don't; where it is null a row is in neither."""
    return Split(df.filter(condition), df.filter(~condition))


def data_type(df: DataFrame, name: str) -> S.DataType | None:
    return next((f.dataType for f in df.schema.fields if f.name == name), None)


def empty_frame(spark: SparkSession, schema: S.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def all_strings(df: DataFrame) -> DataFrame:
    """Every column as a string; nullability stays."""
    return df.select(*[_name(f.name) if isinstance(f.dataType, S.StringType) else _name(f.name).cast("string").alias(f.name) for f in df.schema.fields])


def default_column(f: Field) -> Column:
    return F.lit(f.default).cast(f.type if not isinstance(f.type, S.NullType) else "void")


def add_column_with_default(df: DataFrame, f: Field) -> DataFrame:
    if f.name in df.columns:
        raise ConfigError(f"there is a column {f.name!r} already")
    return df.select("*", default_column(f).alias(f.name))


def set_defaults(df: DataFrame, schema: Schema) -> DataFrame:
    """Nulls in columns of the schema become its defaults, and columns that are missing are added with theirs.

    Other columns stay. A column of another type than the schema's keeps its
    type and takes the default as that type.
    """
    out = []
    for c in df.schema.fields:
        f = schema.field(c.name)
        fills = f is not None and f.default is not None
        out.append(F.coalesce(_name(c.name), (F.lit(f.default_text()) if isinstance(c.dataType, S.StringType) else F.lit(f.default).cast(c.dataType))).alias(c.name) if fills else _name(c.name))
    return df.select(*out, *[default_column(f).alias(f.name) for f in schema.fields if f.name not in df.columns])


def change_schema(df: DataFrame, schema: S.StructType, strict: bool = False) -> Outcome:
    """Columns of df as the schema has them: others go, missing ones are added as null, types are changed.

    Columns that stay keep their order, new ones follow in the schema's. A value
    that can't be converted becomes null; with strict its row goes to errors,
    all as strings, with a message for each such value in CHANGE_ERROR.
    """
    want = {f.name: f for f in schema.fields}
    out, errors = [], []
    for f in df.schema.fields:
        if f.name not in want:
            continue
        to, c = want[f.name].dataType, _name(f.name)
        if to == f.dataType:
            out.append(c)
            continue
        value = c.try_cast(to)
        out.append(value.alias(f.name))
        errors.append(F.when(c.isNotNull() & value.isNull(), F.concat(F.lit(f"could not convert value in field '{f.name}' to '{type(to).__name__}': '"), c.cast("string"), F.lit("'"))))
    out += [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in df.columns]
    error = F.concat_ws("; ", *errors) if errors else F.lit("")
    if not strict:
        return Outcome(df.select(*out), all_strings(df).select("*", F.lit(None).cast("string").alias(CHANGE_ERROR)).limit(0))
    good, bad = df.filter(error == ""), df.filter(error != "")
    return Outcome(good.select(*out), bad.select(*[_name(c).cast("string").alias(c) for c in df.columns], error.alias(CHANGE_ERROR)))


def add_change_errors_to(df: DataFrame, field: str, separator: str = "; ") -> DataFrame:
    """CHANGE_ERROR moves to a field of reasons, behind what is in it."""
    if CHANGE_ERROR not in df.columns:
        return df
    if field not in df.columns:
        return df.withColumnRenamed(CHANGE_ERROR, field)
    return df.withColumn(field, F.concat_ws(separator, _name(field), _name(CHANGE_ERROR))).drop(CHANGE_ERROR)


def reorder_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(set(names)) < len(names) or set(names) != set(df.columns) or len(names) != len(df.columns):
        raise ConfigError(f"{list(names)} is no order of {df.columns}")
    return df.select(*[_name(c) for c in names])


def safe_union(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both, columns matched by name; both must have the same ones."""
    return df.union(reorder_columns(other, df.columns))


def flatten(df: DataFrame) -> DataFrame:
    """Structures replaced by their innermost fields, in place and by their own names; arrays and maps stay."""

    def leaves(fields: Sequence[S.StructField], at: Callable[[str], Column]) -> list[Column]:
        out = []
        for f in fields:
            c = at(f.name)
            out += leaves(f.dataType.fields, c.getField) if isinstance(f.dataType, S.StructType) else [c.alias(f.name)]
        return out

    return df.select(*leaves(df.schema.fields, _name))


def add_if_missing(df: DataFrame, name: str, column: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, column)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def drop_fields_starting_with(df: DataFrame, prefix: str) -> DataFrame:
    """Without columns of a prefix; without any column left there is no row either."""
    if not prefix:
        raise ConfigError("a prefix needs a character")
    keep = [c for c in df.columns if not c.startswith(prefix)]
    return df.select(*[_name(c) for c in keep]) if keep else df.limit(0).select()


def with_numeric_flag(df: DataFrame, field: str, flag: str) -> DataFrame:
    return df.withColumn(flag, is_numeric(_name(field)))


def repartitioned(df: DataFrame, n: int) -> DataFrame:
    """To n partitions: more by a shuffle, fewer without one, 0 or as many as there are not at all."""
    now = df.rdd.getNumPartitions() if n > 0 else n
    return df if n <= 0 or n == now else df.repartition(n) if n > now else df.coalesce(n)


def merge_maps(addition: Column, existing: Column) -> Column:
    """Both maps; where they share a key, the addition's value."""
    rest = F.map_filter(existing, lambda k, _: ~F.map_contains_key(addition, k))
    return F.map_concat(addition, rest)
