"""What an action list has done so far to every record, as columns of one DataFrame.

A value that may be missing is a Slot: whether it is there, and what it is (a
string, or null). Keys that the configuration names are slots of their own, so
Catalyst prunes and folds them one by one; other input fields are only ever
handled all together.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import source as A
from .source import Source

#: A guard: always (True), never (False), or a column that is never null.
Guard = Column | bool


def both(a: Guard, b: Guard) -> Guard:
    if a is False or b is False:
        return False
    return b if a is True else a if b is True else a & b


def either(a: Guard, b: Guard) -> Guard:
    if a is True or b is True:
        return True
    return b if a is False else a if b is False else a | b


def negated(a: Guard) -> Guard:
    return not a if isinstance(a, bool) else ~a


def as_column(a: Guard) -> Column:
    return F.lit(a) if isinstance(a, bool) else a


def pick(g: Guard, new: Column, old: Column | None) -> Column:
    if g is True:
        return new
    if g is False:
        return F.lit(None).cast("string") if old is None else old
    return F.when(g, new) if old is None else F.when(g, new).otherwise(old)


@dataclass(frozen=True)
class Slot:
    there: Guard
    value: Column


def absent() -> Slot:
    return Slot(False, F.lit(None).cast("string"))


class Records:
    """Input records: a map of strings, or the columns of a DataFrame."""

    def __init__(self, fields: Mapping[str, Column] | None = None, strings: Mapping[str, bool] | None = None, whole: Mapping[str, Column] | None = None) -> None:
        #: whole: fields of a whole-number type as they are, for keys that need not be read from text.
        self.fields, self.strings, self.whole = fields, strings, whole or {}

    def slot(self, name: str) -> Slot:
        if self.fields is not None:
            return Slot(True, self.fields[name]) if name in self.fields else absent()
        return Slot(F.map_contains_key("__input", F.lit(name)), F.element_at("__input", F.lit(name)))

    def is_string(self, name: str) -> Guard:
        """Whether a field holds text, rather than a number, a truth value or a structure."""
        if self.fields is not None:
            return bool(self.strings and self.strings.get(name))
        return F.coalesce(F.array_contains("__strings", F.lit(name)), F.lit(False))

    def map(self) -> Column:
        if self.fields is None:
            return F.col("__input")
        if not self.fields:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[c for k, v in self.fields.items() for c in (F.lit(k), v)])


@dataclass(frozen=True)
class State:
    df: DataFrame
    records: Records
    enriched: Mapping[str, Slot] = field(default_factory=dict)
    scratch: Mapping[str, Slot] = field(default_factory=dict)
    results: Mapping[str, Slot] = field(default_factory=dict)
    reasons: Column | None = None
    stopped: Guard = False
    error: Column | None = None
    #: Where all input fields have been copied at once, with "" for null.
    copied: Guard = False
    #: Hits and selected columns of lookups that are joined before the actions: by the action.
    joined: Mapping = field(default_factory=dict)
    serial: int = 0

    def column(self, name: str, c: Column) -> tuple[State, Column]:
        """The state with c as a column of its own, so that what refers to it often doesn't repeat it."""
        name = f"__{name}_{self.serial}"
        return replace(self, df=self.df.withColumn(name, c), serial=self.serial + 1), F.col(name)

    def guard(self, g: Guard) -> tuple[State, Guard]:
        return (self, g) if isinstance(g, bool) else self.column("g", F.coalesce(g, F.lit(False)))

    def slot(self, s: Source) -> Slot:
        if s.location == A.CONSTANT:
            return Slot(True, F.lit(s.name))
        if s.location == A.INPUT:
            return self.records.slot(s.name)
        if s.location == A.ENRICHED:
            return self.enriched.get(s.name) or self.unnamed(s.name)
        if s.location == A.SCRATCHPAD:
            return self.scratch.get(s.name) or absent()
        first, second = self.slot(Source(A.ENRICHED, s.name)), self.records.slot(s.name)
        if first.there is False:
            return second
        return Slot(either(first.there, second.there), pick(first.there, first.value, second.value))

    def entries(self) -> Column:
        """What actions have put into enriched, as a map."""
        if not self.enriched:
            return F.create_map().cast("map<string,string>")
        each = [F.struct(as_column(s.there).alias("there"), F.lit(k).alias("key"), s.value.alias("value")) for k, s in self.enriched.items()]
        there = F.transform(F.filter(F.array(*each), lambda e: e["there"]), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        return F.map_from_entries(there)

    def unnamed(self, name: str) -> Slot:
        """A field of enriched that no action names: there if all were copied."""
        if self.copied is False:
            return absent()
        s = self.records.slot(name)
        return Slot(both(self.copied, s.there), F.coalesce(s.value, F.lit("")))

    def put(self, where: str, g: Guard, key: str, value: Column, there: Guard = True) -> State:
        """value under key where g and there hold."""
        g = both(g, there)
        if g is False:
            return self
        table = dict(getattr(self, where))
        old = self.slot(Source(A.ENRICHED, key)) if where == "enriched" else table.get(key) or absent()
        state, column = self.column("v", pick(g, value.cast("string"), old.value))
        there = either(old.there, g)
        if not isinstance(there, bool):
            state, there = state.column("p", there)
        table[key] = Slot(there, column)
        return replace(state, **{where: table})

    def fail(self, g: Guard, message: Column | str) -> State:
        message = F.lit(message) if isinstance(message, str) else message
        old = self.error if self.error is not None else F.lit(None).cast("string")
        state, column = self.column("e", F.coalesce(old, F.when(as_column(g), message)))
        return replace(state, error=column)

    def reject(self, g: Guard, reason: Column, stop: bool) -> State:
        """Add a trimmed reason, none where it is null or blank; stop the list either way."""
        if g is False:
            return self
        state, reason = self.column("r", F.trim(reason))
        old = self.reasons if self.reasons is not None else F.array().cast("array<string>")
        some = both(g, F.coalesce(reason != "", F.lit(False)))
        state, column = state.column("a", F.when(some, F.concat(old, F.array(reason))).otherwise(old))
        state = replace(state, reasons=column)
        if stop:
            state, stopped = state.guard(either(self.stopped, g))
            state = replace(state, stopped=stopped)
        return state
