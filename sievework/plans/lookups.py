"""Lookups in tables, joined before the actions run.

A lookup's key is an input field, which no action changes, so every lookup,
however deep in branches, is a left join on a unique key that can stand first;
lookups that agree in table, key column and field share one join, and each
table is read once with the columns that any of them selects.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import ConfigError
from ..functions.convert import text_to
from . import config as C
from .state import State


@dataclass(frozen=True)
class Requirement:
    table: str
    file: str | None
    columns: tuple[str, ...]


def requirements(nodes: Sequence[C.Node]) -> dict[str, Requirement]:
    """For each table its file and all columns that lookups use."""
    out: dict[str, Requirement] = {}
    for n in nodes:
        if isinstance(n, C.Lookup):
            old = out.get(n.table)
            if old and n.file and old.file and n.file != old.file:
                raise ConfigError(f"table {n.table!r} is to be read from two files")
            columns = dict.fromkeys([*(old.columns if old else ()), n.where, *n.select])
            out[n.table] = Requirement(n.table, n.file or (old.file if old else None), tuple(columns))
    return out


def read_table(spark: SparkSession, need: Requirement, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The table, from tables, or a JSON file that becomes a view, or the catalog; only the columns needed."""
    if tables and need.table in tables:
        df = tables[need.table]
    elif need.file:
        df = spark.read.json(need.file)
        df.createOrReplaceTempView(need.table.replace(".", "_"))
    elif spark.catalog.tableExists(need.table):
        df = spark.table(need.table)
    else:
        raise ConfigError(f"no such table: {need.table!r}; give it with tables, in the catalog, or as a file")
    gone = [c for c in need.columns if c not in df.columns]
    if gone:
        raise ConfigError(f"table {need.table!r} has no columns {gone}")
    return df.select(*[F.col(f"`{c}`") for c in need.columns])


def key_of(text: Column, kind: S.DataType) -> Column:
    """The input's text as the key column's type, untrimmed; null if it is no such value."""
    if isinstance(kind, (S.StringType, S.IntegerType, S.LongType, S.DoubleType, S.BooleanType)):
        return text_to(text, kind)
    return text.try_cast(kind)


def by_key(table: DataFrame, where: str, columns: Sequence[str]) -> DataFrame:
    """(__key, __row): a row for each key that isn't null, the smallest by its columns where a key repeats."""
    cells = F.struct(*[F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
    return table.filter(F.col(f"`{where}`").isNotNull()).groupBy(F.col(f"`{where}`").alias("__key")).agg(F.min(cells).alias("__row"))


def joined(state: State, program: C.Program, tables: Mapping[str, DataFrame] | None = None) -> State:
    """The state with every lookup's hit and cells; sizes of the tables decide how Spark joins them."""
    df, found, read = state.df, dict(state.joined), {}
    needs = requirements(program.nodes)
    selects: dict[tuple[str, str, str], dict[str, None]] = {}
    for n in program.nodes:
        if isinstance(n, C.Lookup):
            selects.setdefault((n.table, n.where, n.equals), {}).update(dict.fromkeys(n.select))
    for i, ((table, where, equals), columns) in enumerate(selects.items()):
        if table not in read:
            read[table] = read_table(df.sparkSession, needs[table], tables)
        kind = read[table].schema[where].dataType
        rows = by_key(read[table], where, list(columns)).select(F.col("__key").alias(f"__lk{i}"), F.col("__row").alias(f"__lr{i}"))
        whole = state.records.whole.get(equals)
        as_is = whole is not None and isinstance(kind, (S.IntegerType, S.LongType))
        key = whole.try_cast(kind) if as_is else key_of(state.records.slot(equals).value, kind)
        df = df.join(rows, key == F.col(f"__lk{i}"), "left")
        found[table, where, equals] = F.col(f"__lk{i}").isNotNull(), {c: F.col(f"__lr{i}").getField(c) for c in columns}
    return replace(state, df=df, joined=found)


def lookup(table: DataFrame, key: str, values: DataFrame, value: str, select: Sequence[str] | None = None) -> DataFrame:
    """values with the columns select of the table's row for each value, null where there is none."""
    select = list(select or [c for c in table.columns if c != key])
    rows = by_key(table, key, select)
    return values.join(rows, F.col(value) == F.col("__key"), "left").select(*[values[c] for c in values.columns], *[F.col("__row").getField(c).alias(c) for c in select])
