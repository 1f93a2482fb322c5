"""Configurations run over records: compiled once into one plan of joins and column expressions.

    pipeline = Pipeline.of(config, tables={"dim": dim})
    pipeline.over_json(spark.read.text(folder))     # enriched MAP<STRING,STRING>
    pipeline.over_table(df)                         # a string column for each field

No row is looked at to build the plan, and no Python runs on the executors
unless a custom action brings its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError
from .operators.actions import run_list
from .plans import config as C
from .plans.lookups import joined
from .plans.state import Slot, State, as_column, either, pick
from .sources import records as R

#: The key of enriched that lists the input fields which no action had copied.
AUTO_COPIED = "__sievework_auto_copied__"
#: The scratch result that the error list can reject with.
UNHANDLED = "unhandled-exception"


@dataclass(frozen=True)
class JdbcClient:
    """A named database; its tables are read by Spark's JDBC source.

    The executors connect to url too, so it must name a database that all of
    them reach: one in the driver's memory is there only where the driver runs
    the tasks itself (see sources/derby.py for one in a file).

    split names, for large tables, a whole-number or date column with its least
    and greatest value, and the number of connections that read its ranges at
    once: {table: (column, least, greatest, connections)}. Columns that a lookup
    doesn't use aren't read, and filters go to the database.
    """

    name: str
    url: str
    properties: Mapping[str, str] = field(default_factory=dict)
    split: Mapping[str, tuple[str, int | str, int | str, int]] = field(default_factory=dict)

    def table(self, spark: SparkSession, table: str) -> DataFrame:
        properties = dict(self.properties)
        if table not in self.split:
            return spark.read.jdbc(self.url, table, properties=properties)
        column, least, greatest, connections = self.split[table]
        return spark.read.jdbc(self.url, table, column=column, lowerBound=least, upperBound=greatest, numPartitions=connections, properties=properties)


def _clients(clients: Sequence[JdbcClient]) -> Callable[[SparkSession, str, str], DataFrame]:
    names = {c.name: c for c in clients}
    if len(names) < len(clients):
        raise ConfigError("two JDBC clients have one name")

    def read(spark: SparkSession, client: str, table: str) -> DataFrame:
        if client not in names:
            raise ConfigError(f"no such JDBC client: {client!r}")
        return names[client].table(spark, table)

    return read


@dataclass(frozen=True)
class Pipeline:
    program: C.Program
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    scratch: Mapping[str, str | None] = field(default_factory=dict)
    clients: Sequence[JdbcClient] = ()
    malformed: str = R.FAIL

    @staticmethod
    def of(config: str | dict, creators: Sequence[C.Creator] = (), checkers: Mapping[str, C.Checker] | None = None, **more: Any) -> Pipeline:
        """checkers: predicates of the user's for check actions, by the op that names them."""
        return Pipeline(C.parse(config, creators, checkers), **more)

    def _start(self, state: State) -> State:
        return replace(state, scratch={k: Slot(True, F.lit(v)) for k, v in self.scratch.items()}, joined={"clients": _clients(self.clients)})

    def run(self, state: State) -> tuple[State, State | None]:
        """The state after all items, and that of the error list if a record can get there."""
        state = joined(self._start(state), self.program, self.tables)
        for item in self.program.items:
            # Stopping ends with the item that was stopped.
            state = run_list(item.actions, replace(state, stopped=False), True)
        if state.error is None:
            return state, None
        other = replace(state, enriched={}, scratch=self._start(state).scratch, results={UNHANDLED: Slot(True, state.error)}, reasons=None, stopped=False, copied=False)
        done = run_list(self.program.on_error, other, True)
        return replace(state, df=done.df, serial=done.serial), done

    def over_json(self, df: DataFrame, auto_copy: bool = True) -> DataFrame:
        """df, with JSON objects in a column value, as (enriched, reasons); records that end up empty are left out.

        A field that no action has put into enriched is copied at the end, and
        AUTO_COPIED lists these, sorted and joined by commas. A record with an
        error has what the error list makes of it alone.
        """
        kinds = any(isinstance(n, C.Check) and n.op.endswith("numeric") for n in self.program.nodes)
        state, other = self.run(R.json_state(df, self.malformed, kinds))
        error, reasons, copied = state.error, _reasons(state), state.copied
        # Columns of their own: what follows refers to them for each key.
        state, enriched = state.column("m", state.entries())
        if other is not None:
            state, caught = state.column("m", other.entries())
        some = F.size(enriched) > 0
        if auto_copy:
            state, there = state.column("k", F.map_keys(enriched))
            state, rest = state.column("m", F.map_filter("__input", lambda k, _: ~F.array_contains(there, k)))
            some = some | (F.size(rest) > 0)
            names = F.array_join(F.array_sort(F.map_keys(rest)), ",")
            if copied is not False:
                blank = F.transform_values(rest, lambda _, v: F.coalesce(v, F.lit("")))
                rest, names = F.when(as_column(copied), blank).otherwise(rest), F.when(~as_column(copied), names)
            marker = F.when(F.coalesce(names != "", F.lit(False)), F.create_map(F.lit(AUTO_COPIED), names)).otherwise(F.create_map().cast("map<string,string>"))
            enriched = F.map_concat(enriched, rest, marker)
        if other is not None:
            if other.copied is not False:
                rest = F.transform_values(F.map_filter("__input", lambda k, _: ~F.map_contains_key(caught, k)), lambda _, v: F.coalesce(v, F.lit("")))
                caught = F.when(as_column(other.copied), F.map_concat(caught, rest)).otherwise(caught)
            some = F.when(error.isNotNull(), F.size(caught) > 0).otherwise(some)
            enriched = F.when(error.isNotNull(), caught).otherwise(enriched)
            reasons = F.when(error.isNotNull(), _reasons(other)).otherwise(reasons)
        return state.df.filter(some).select(enriched.alias("enriched"), reasons.alias("reasons"))

    def over_table(self, df: DataFrame, marker: bool = True) -> DataFrame:
        """The rows of df as records, and the result as string columns: input fields, then those that actions add.

        A field that isn't there is null; AUTO_COPIED is as in over_json().
        What no one reads of the result is not computed.
        """
        state, other = self.run(R.table_state(df))
        names = list(dict.fromkeys([*df.columns, *state.enriched, *(other.enriched if other else ())]))
        out, copied = [], []
        for name in names:
            s, own = state.enriched.get(name), state.records.slot(name)
            rest = own.value if state.copied is False else F.when(as_column(state.copied), F.coalesce(own.value, F.lit(""))).otherwise(own.value)
            value = rest if s is None else pick(s.there, s.value, rest if own.there is not False else F.lit(None).cast("string"))
            if own.there is not False:
                done = either(False if s is None else s.there, state.copied)
                copied.append((name, F.when(~as_column(done), F.lit(name))))
            if other is not None:
                o = other.enriched.get(name) or other.unnamed(name)
                value = F.when(state.error.isNotNull(), F.when(as_column(o.there), o.value)).otherwise(value)
            out.append(value.alias(name))
        if marker:
            listed = F.concat_ws(",", *[c for _, c in sorted(copied, key=lambda x: x[0])])
            listed = F.when(listed != "", listed)
            out.append((F.when(state.error.isNull(), listed) if other is not None else listed).alias(AUTO_COPIED))
        rows = state.df
        if other is not None and not other.enriched:
            rows = rows.filter(state.error.isNull())
        return rows.select(*out)


def _reasons(state: State):
    return state.reasons if state.reasons is not None else F.array().cast("array<string>")


def process_dir(spark: SparkSession, path: str, config: str | dict, creators: Sequence[C.Creator] = (), **more: Any) -> DataFrame:
    """JSON lines in a file or folder."""
    return Pipeline.of(config, creators, **more).over_json(R.json_lines(spark, path))


def process_json_strings(spark: SparkSession, lines: Iterable[str], config: str | dict, creators: Sequence[C.Creator] = (), **more: Any) -> DataFrame:
    return Pipeline.of(config, creators, **more).over_json(R.json_strings(spark, lines))


def process_table(df: DataFrame, config: str | dict, creators: Sequence[C.Creator] = (), **more: Any) -> DataFrame:
    return Pipeline.of(config, creators, **more).over_table(df)
