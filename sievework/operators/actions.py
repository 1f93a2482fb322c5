"""Actions over a State: each takes the state and the guard under which it runs, and returns the state after it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import singledispatch

from pyspark.sql import functions as F

from ..plans import config as C
from ..plans import source as A
from ..plans.state import Guard, State, as_column, both, either, negated
from .checks import predicate


@singledispatch
def apply(action: C.Node, state: State, g: Guard) -> State:
    raise TypeError(f"no such action: {action!r}")


def run_list(actions: Sequence[C.Node], state: State, g: Guard) -> State:
    """Actions in turn; one that stops the list keeps the rest of it, and of the lists around it, from running."""
    for action in actions:
        now = both(g, negated(state.stopped))
        if now is False:
            break
        if state.stopped is not False:
            state, now = state.guard(now)
        state = apply(action, state, now)
    return state


def branch(state: State, passed: Guard, g: Guard, on_pass: Sequence[C.Node], on_fail: Sequence[C.Node]) -> State:
    state, passed = state.guard(passed)
    for actions, side in ((on_pass, passed), (on_fail, negated(passed))):
        if actions:
            state, here = state.guard(both(g, side))
            state = run_list(actions, state, here)
    return state


@apply.register
def _(a: C.Nothing, state: State, g: Guard) -> State:
    return state


@apply.register
def _(a: C.Custom, state: State, g: Guard) -> State:
    return a.apply(state, g)


def row_action(function: Callable[[dict, dict], dict | None], writes: Sequence[str]) -> C.Custom:
    """An action in plain Python, for what columns can't express; it runs in Arrow batches and is slow beside the others.

    function gets a record's input and what is enriched so far, as dicts of
    strings, and may return {"updates": {...}, "reason": str, "stop": bool}.
    Updates count for the keys in writes. What it raises is the record's error.
    """

    def safe(record: dict | None, enriched: dict | None) -> dict:
        try:
            out = function(dict(record or {}), dict(enriched or {})) or {}
            return {"updates": out.get("updates") or {}, "reason": out.get("reason"), "stop": bool(out.get("stop")), "error": None}
        except Exception as error:  # noqa: BLE001  it becomes the record's error
            return {"updates": {}, "reason": None, "stop": False, "error": f"{type(error).__name__}: {error}"}

    def run(state: State, g: Guard) -> State:
        call = F.udf(safe, "struct<updates:map<string,string>,reason:string,stop:boolean,error:string>", useArrow=True)
        state, out = state.column("u", call(state.records.map(), state.entries()))
        for key in writes:
            state = state.put("enriched", g, key, F.element_at(out["updates"], F.lit(key)), F.map_contains_key(out["updates"], F.lit(key)))
        state = state.fail(both(g, out["error"].isNotNull()), out["error"])
        state = state.reject(both(g, out["reason"].isNotNull()), out["reason"], False)
        state, stopped = state.guard(either(state.stopped, both(g, out["stop"])))
        return replace(state, stopped=stopped)

    return C.Custom(run)


@apply.register
def _(a: C.AddFields, state: State, g: Guard) -> State:
    for key, value in a.pairs:
        state = state.put("enriched", g, key, F.lit(value))
    return state


@apply.register
def _(a: C.Copy, state: State, g: Guard) -> State:
    """Under another name; missing and null are left out, "" is copied."""
    for name, target in a.pairs:
        s = state.records.slot(name)
        state = state.put("enriched", g, target, s.value, both(s.there, s.value.isNotNull()))
    return state


@apply.register
def _(a: C.SimpleCopy, state: State, g: Guard) -> State:
    """Under the same name; missing is left out, null is copied."""
    for name in a.fields:
        s = state.records.slot(name)
        state = state.put("enriched", g, name, s.value, s.there)
    return state


@apply.register
def _(a: C.SearchReplace, state: State, g: Guard) -> State:
    """Of the input field, by a Java pattern; missing and null are left out."""
    for name in a.fields:
        s = state.records.slot(name)
        state = state.put("enriched", g, name, F.regexp_replace(s.value, F.lit(a.search), F.lit(a.replace)), both(s.there, s.value.isNotNull()))
    return state


@apply.register
def _(a: C.ReplaceNull, state: State, g: Guard) -> State:
    """Where a field is there and null; a missing one stays missing."""
    for s in a.fields:
        slot = state.slot(s)
        state = state.put("scratch" if a.output == A.SCRATCHPAD else "enriched", g, s.name, F.lit(a.value), both(slot.there, slot.value.isNull()))
    return state


@apply.register
def _(a: C.AddScratch, state: State, g: Guard) -> State:
    """Missing is left out; null in the scratchpad is an error of the record."""
    for name in a.fields:
        s = state.scratch.get(name)
        if s is not None:
            state = state.fail(both(g, both(s.there, s.value.isNull())), f"null in the scratchpad under '{name}'")
            state = state.put("enriched", g, name, s.value, s.there)
    return state


@apply.register
def _(a: C.Reject, state: State, g: Guard) -> State:
    if a.reason is not None:
        return state.reject(g, F.lit(a.reason), a.stop)
    s = state.results.get(a.reason_from)
    reason = F.lit(None).cast("string") if s is None else F.when(as_column(s.there), s.value)
    return state.reject(g, reason, a.stop)


@apply.register
def _(a: C.AddRejectionReason, state: State, g: Guard) -> State:
    """Where there are reasons: all of them into one field, then each input field that isn't enriched yet, "" for null."""
    if state.reasons is None:
        return state
    state, some = state.guard(both(g, F.size(state.reasons) > 0))
    state = state.put("enriched", some, a.field, F.array_join(state.reasons, "; "))
    for key, slot in list(state.enriched.items()):
        s = state.records.slot(key)
        state = state.put("enriched", some, key, F.coalesce(s.value, F.lit("")), both(s.there, negated(slot.there)))
    copied = as_column(state.copied) | as_column(some)
    state, copied = state.guard(copied)
    return replace(state, copied=copied)


@apply.register
def _(a: C.Check, state: State, g: Guard) -> State:
    state, passed = state.guard(predicate(a, state))
    return branch(state, passed, g, a.on_pass, a.on_fail)


def looked_up(state: State, g: Guard, kind: str, hit: Guard, cells: dict, found, failed) -> State:
    """Put what a lookup has found, and its message, before its branches run."""
    state, hit = state.guard(hit)
    for name, value in cells.items():
        state = state.put("enriched", both(g, hit), name, value, value.isNotNull())
    return state.put("results", g, kind, F.when(as_column(hit), found).otherwise(failed)), hit


@apply.register
def _(a: C.Lookup, state: State, g: Guard) -> State:
    hit, cells = state.joined[a.table, a.where, a.equals]
    key = state.records.slot(a.equals)
    text = F.coalesce(key.value, F.lit(""))
    found = F.concat(F.lit(f"Field '{a.where}' exists in table '{a.table}':  '"), text, F.lit("'"))
    state, hit = looked_up(state, g, "lookup", hit, {c: cells[c] for c in a.select}, found, F.concat(F.lit(f"Invalid {a.where}: '"), text, F.lit("'")))
    return branch(state, hit, g, a.on_pass, a.on_fail)


@apply.register
def _(a: C.JdbcLookup, state: State, g: Guard) -> State:
    """One row with no null among the selected columns is a hit. The join is here, as keys may be values of earlier actions.

    A condition beyond equal keys is answered for the different combinations of
    the values that it refers to, and these are joined back as keys: so records
    meet answers by equality, and only combinations meet rows by the condition,
    which Spark does by hash for the equalities in it and by a nested loop
    without any.
    """
    n = state.serial
    state = replace(state, serial=n + 1)
    names = {c: f"__j{n}_{i}" for i, c in enumerate(a.select)}
    asked = []
    for s in [s for _, s in a.keys] or a.values:
        slot = state.slot(s)
        state, key = state.column("q", F.when(as_column(slot.there), slot.value))
        asked.append(key)
    cells = [F.col(c).cast("string").alias(names[c]) for c in a.select]
    table = state.joined["clients"](state.df.sparkSession, a.client, a.table)
    if a.keys:
        rows = table.select(*[F.col(c).cast("string").alias(f"__k{n}_{i}") for i, (c, _) in enumerate(a.keys)], *cells)
    else:
        values = [f"__k{n}_{i}" for i in range(len(asked))]
        known = state.df.select(*[k.alias(v) for k, v in zip(asked, values, strict=True)]).distinct()
        rows = known.join(table, F.expr(a.condition.format(*values))).select(*values, *cells)
    rows = rows.groupBy(*[f"__k{n}_{i}" for i in range(len(asked))]).agg(F.count(F.lit(1)).alias(f"__n{n}"), *[F.min(x).alias(x) for x in names.values()])
    same = (lambda x, y: x == y) if a.keys else (lambda x, y: x.eqNullSafe(y))
    conditions = [same(key, F.col(f"__k{n}_{i}")) for i, key in enumerate(asked)]
    state = replace(state, df=state.df.join(rows, conditions, "left"))
    count = F.coalesce(F.col(f"__n{n}"), F.lit(0))
    whole = F.lit(True)
    for x in names.values():
        whole = whole & F.col(x).isNotNull()
    message = F.when(count == 0, "no row found").when(count > 1, "more than one row found").otherwise("null in a selected column")
    state, hit = looked_up(state, g, "jdbc-lookup", (count == 1) & whole, {c: F.trim(F.col(x)) for c, x in names.items()}, F.lit(f"found in '{a.table}'"), message)
    return branch(state, hit, g, a.on_pass, a.on_fail)
