"""Predicates of check actions. A predicate is never null, so that one of the branches runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.convert import text_to_double, trimmed
from ..plans import config as C
from ..plans import source as A
from ..plans.state import Guard, Slot, State, as_column, both, negated


def numeric(state: State, name: str, numbers: bool = False) -> Guard:
    """Whether an input field is text that reads as a double; with numbers, JSON numbers count too."""
    s = state.records.slot(name)
    reads = F.coalesce((s.value != "") & text_to_double(trimmed(s.value)).isNotNull(), F.lit(False))
    return both(reads, True if numbers else state.records.is_string(name))


def is_true(state: State, name: str) -> Guard:
    """Whether an input field is the text "true" in any case."""
    s = state.records.slot(name)
    return both(F.coalesce(F.lower(s.value) == "true", F.lit(False)), state.records.is_string(name))


def true_checker(left: Slot, right: Slot | None) -> Guard:
    """A checker: whether a field is the text "true" in any case."""
    return both(left.there, F.lower(left.value) == "true")


def predicate(a: C.Check, state: State) -> Guard:
    s = state.slot(a.left)
    if a.test is not None:
        found = a.test(s, None if a.right is None else state.slot(a.right))
        return found if isinstance(found, bool) else F.coalesce(found, F.lit(False))
    if a.op in ("empty", "not-empty", "non-empty"):
        empty = F.coalesce(s.value, F.lit("")) == "" if s.there is not False else True
        if not isinstance(s.there, bool):
            empty = ~s.there | empty
        return empty if a.op == "empty" else negated(empty)
    if a.op in ("null", "non-null"):
        null = both(s.there, s.value.isNull())
        return null if a.op == "null" else negated(null)
    if a.op in ("numeric", "non-numeric"):
        if a.explicit and a.left.location != A.INPUT:
            yes = F.coalesce((s.value != "") & text_to_double(trimmed(s.value)).isNotNull(), F.lit(False)) & as_column(s.there)
        else:
            yes = numeric(state, a.left.name)
        return yes if a.op == "numeric" else negated(yes)
    t = state.slot(a.right)
    x, y = (s.value, t.value) if a.case_sensitive else (F.lower(s.value), F.lower(t.value))
    return both(both(s.there, t.there), x.eqNullSafe(y))
