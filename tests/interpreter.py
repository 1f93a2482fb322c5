"""A row-at-a-time reading of the configuration's meaning, to hold the compiled plans against."""

from __future__ import annotations

import json
import re

MARKER = "__sievework_auto_copied__"


def text(v):
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, separators=(",", ":"))


class Row:
    def __init__(self, record: dict, tables: dict) -> None:
        self.input, self.tables = record, tables
        self.enriched, self.scratch, self.results, self.reasons, self.stopped = {}, {}, {}, [], False

    def find(self, address: str, default: str = "enriched-then-input"):
        """(there, value)"""
        where, name = address[1:].split(".") if address.startswith("$") else (default, address)
        if where == "constant":
            return True, name
        if where in ("enriched", "enriched-then-input") and name in self.enriched:
            return True, self.enriched[name]
        if where == "scratchpad":
            return name in self.scratch, self.scratch.get(name)
        if where in ("input", "enriched-then-input") and name in self.input:
            return True, text(self.input[name])
        return False, None

    def run(self, actions: list[dict]) -> None:
        for a in actions:
            if self.stopped:
                return
            getattr(self, "do_" + a["actionType"].replace("-", "_"))(a.get("config"))

    def do_null(self, c): ...

    def do_add_enriched_field(self, c):
        for x in c:
            self.enriched[x["key"]] = x["value"]

    def do_copy(self, c):
        for x in c:
            if self.input.get(x["inputSource"]) is not None:
                self.enriched[x["outputTarget"]] = text(self.input[x["inputSource"]])

    def do_simple_copy(self, c):
        for k in c["inputSource"]:
            if k in self.input:
                self.enriched[k] = text(self.input[k])

    def do_search_and_replace(self, c):
        for k in c["inputSource"]:
            if self.input.get(k) is not None:
                self.enriched[k] = re.sub(c["searchFor"], c["replaceWith"], text(self.input[k]))

    def do_replace_null(self, c):
        for k in c.get("fields") or [c["field"]]:
            there, v = self.find(k)
            if there and v is None:
                (self.scratch if c.get("outputTo") == "scratchpad" else self.enriched)[k] = c["newValue"]

    def do_add_scratch_to_enriched(self, c):
        for k in c["fields"]:
            if k in self.scratch:
                self.enriched[k] = self.scratch[k]

    def do_reject(self, c):
        reason = c.get("reason") or self.results.get(c.get("reasonFrom")) or ""
        if reason.strip():
            self.reasons.append(reason.strip())
        self.stopped |= c.get("stopProcessingActionList", True)

    def do_add_rejection_reason(self, c):
        if self.reasons:
            self.enriched[c["field"]] = "; ".join(self.reasons)
            for k, v in self.input.items():
                if k not in self.enriched:
                    self.enriched[k] = "" if v is None else text(v)

    def do_check(self, c):
        there, v = self.find(c["field"] if "field" in c else c["left"])
        op = c["op"]
        if op in ("empty", "not-empty"):
            yes = not v
        elif op in ("null", "non-null"):
            yes = there and v is None
        elif op in ("numeric", "non-numeric"):
            raw = self.input.get(c["field"])
            yes = isinstance(raw, str) and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", raw.strip()) is not None
        else:
            other, w = self.find(c["right"])
            fold = (lambda x: x) if c.get("caseSensitive", True) else (lambda x: x and x.lower())
            yes = there and other and fold(v) == fold(w)
        if op in ("not-empty", "non-null", "non-numeric"):
            yes = not yes
        self.run(c.get("onPass" if yes else "onFail") or [])

    def do_lookup(self, c):
        key = text(self.input.get(c["equals"]))
        row = self.tables[c["fromDBTable"]].get(key)
        if row:
            self.enriched.update({k: row[k] for k in c["select"] if row[k] is not None})
            self.results["lookup"] = f"Field '{c['where']}' exists in table '{c['fromDBTable']}':  '{key}'"
        else:
            self.results["lookup"] = f"Invalid {c['where']}: '{key or ''}'"
        self.run(c.get("onPass" if row else "onFail") or [])


def process(config: dict, record: dict, tables: dict) -> tuple[dict, list[str]]:
    row = Row(record, tables)
    for item in config.get("items", []):
        row.stopped = False
        row.run(item["actions"])
    rest = {k: text(v) for k, v in record.items() if k not in row.enriched}
    out = row.enriched | rest
    if rest:
        out[MARKER] = ",".join(sorted(rest))
    return out, row.reasons
