import json
import random

import pytest
from interpreter import process
from pyspark.sql import functions as F

from sievework.engine import AUTO_COPIED, JdbcClient, Pipeline, process_dir, process_json_strings, process_table
from sievework.errors import ConfigError
from sievework.operators.actions import row_action
from sievework.plans import config as C
from sievework.plans.lookups import lookup, requirements
from sievework.plans.source import Source
from sievework.sources import records as R


def act(kind, config=None):
    return {"actionType": kind, "config": config}


def items(*lists):
    return {"items": [{"actions": x} for x in lists]}


def run(spark, config, *rows, **more):
    df = process_json_strings(spark, [json.dumps(r) for r in rows], config, **more)
    return [(dict(r.enriched), list(r.reasons)) for r in df.collect()]


ADD = act("add-enriched-field", [{"key": "hit", "value": "1"}])
MISS = act("add-enriched-field", [{"key": "miss", "value": "1"}])


def test_no_items_copies_everything(spark):
    [(out, reasons)] = run(spark, {}, {"A": "A", "C": 10, "D": "", "E": None, "S": {"x": [1, 2]}})
    assert out == {"A": "A", "C": "10", "D": "", "E": None, "S": '{"x":[1,2]}', AUTO_COPIED: "A,C,D,E,S"} and reasons == []


def test_nothing_left_drops_the_record(spark):
    assert run(spark, {}, {}) == []


@pytest.mark.parametrize(
    ("action", "missing", "null", "blank"),
    [
        (act("copy", [{"inputSource": "f", "outputTarget": "t"}]), None, None, {"t": ""}),
        (act("simple-copy", {"inputSource": ["f"]}), None, {"f": None}, {"f": ""}),
        (act("search-and-replace", {"inputSource": ["f"], "searchFor": "a", "replaceWith": "b"}), None, None, {"f": ""}),
        (act("replace-null", {"field": "f", "newValue": "n"}), None, {"f": "n"}, None),
        (act("check", {"field": "f", "op": "empty", "onPass": [ADD], "onFail": [MISS]}), {"hit": "1"}, {"hit": "1"}, {"hit": "1"}),
        (act("check", {"field": "f", "op": "null", "onPass": [ADD], "onFail": [MISS]}), {"miss": "1"}, {"hit": "1"}, {"miss": "1"}),
        (act("check", {"field": "f", "op": "numeric", "onPass": [ADD], "onFail": [MISS]}), {"miss": "1"}, {"miss": "1"}, {"miss": "1"}),
        (act("check", {"left": "f", "op": "equals", "right": "$input.g", "onPass": [ADD], "onFail": [MISS]}), {"miss": "1"}, {"hit": "1"}, {"miss": "1"}),
    ],
)
def test_missing_null_and_blank(spark, action, missing, null, blank):
    for record, want in (({}, missing), ({"f": None}, null), ({"f": ""}, blank)):
        full = record | {"g": None, "keep": "k"}
        out = run(spark, items([action]), full)[0][0]
        copied = set(out.pop(AUTO_COPIED).split(","))
        assert {k: v for k, v in out.items() if k not in copied} == (want or {})


@pytest.mark.parametrize(("value", "yes"), [("597", 1), ("-597", 1), ("597.859", 1), (" 5 ", 1), ("1e5", 1), ("sjg3", 0), ("1d", 0), ("1F", 0), ("inf", 0), (" ", 0), (5, 0), (5.5, 0), (True, 0)])
def test_numeric_reads_text_only(spark, value, yes):
    out = run(spark, items([act("check", {"field": "f", "op": "numeric", "onPass": [ADD], "onFail": [MISS]})]), {"f": value})[0][0]
    assert ("hit" in out) == bool(yes) and ("miss" in out) != bool(yes)


def test_stop_leaves_nested_and_outer_list_but_not_the_next_item(spark):
    inner = act("check", {"field": "a", "op": "not-empty", "onPass": [act("reject", {"reason": " one "}), ADD]})
    out, reasons = run(spark, items([inner, MISS], [act("add-enriched-field", [{"key": "next", "value": "1"}]), act("add-rejection-reason", {"field": "why"})]), {"a": "x", "n": None})[0]
    assert out == {"a": "x", "n": "", "next": "1", "why": "one"} and reasons == ["one"]


def test_rejection_reason_from_an_unknown_result_only_stops(spark):
    out, reasons = run(spark, items([act("reject", {"reasonFrom": "check"}), ADD]), {"a": "x"})[0]
    assert "hit" not in out and reasons == []


def test_error_list_makes_the_record(spark):
    config = items([ADD, act("add-scratch-to-enriched", {"fields": ["hole"]})]) | {"global": {"exceptionHandlingList": [act("reject", {"reasonFrom": "unhandled-exception", "stopProcessingActionList": False}), act("add-rejection-reason", {"field": "why"})]}}
    out, _ = run(spark, config, {"a": "x"}, scratch={"hole": None})[0]
    assert out == {"why": "null in the scratchpad under 'hole'", "a": "x"}
    assert run(spark, items([act("add-scratch-to-enriched", {"fields": ["hole"]})]), {"a": "x"}, scratch={"hole": None}) == []


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"a": "1"}\n\n{oops\n')
    with pytest.raises(Exception, match="not a JSON object"):
        process_dir(spark, str(tmp_path), {}).collect()
    config = {"global": {"exceptionHandlingList": [act("add-enriched-field", [{"key": "bad", "value": "1"}])]}}
    rows = process_dir(spark, str(tmp_path), config, malformed=R.ERROR).collect()
    assert sorted(sorted(r.enriched) for r in rows) == [[AUTO_COPIED, "a"], ["bad"]]


def test_lookup_keys_duplicates_and_messages(spark):
    dim = spark.createDataFrame([(1, " one ", 1.5), (2, "zwei", None), (2, "two", None), (None, "none", 0.0)], "k int, name string, v double")
    find = act("lookup", {"select": ["name", "v"], "fromDBTable": "db.dim", "where": "k", "equals": "key", "onFail": [act("reject", {"reasonFrom": "lookup"})], "onPass": [ADD]})
    got = run(spark, items([find]), {"key": "1"}, {"key": 2}, {"key": " 1"}, {"other": 1}, {"key": None}, tables={"db.dim": dim})
    assert [g[0].get("name") for g in got] == ["one", "two", None, None, None] and [g[0].get("v") for g in got] == ["1.5", None, None, None, None]
    assert [g[1] for g in got] == [[], [], ["Invalid k: ' 1'"], ["Invalid k: ''"], ["Invalid k: ''"]]
    with pytest.raises(ConfigError):
        run(spark, items([act("lookup", {"select": ["nope"], "fromDBTable": "db.dim", "where": "k", "equals": "key"})]), {"key": "1"}, tables={"db.dim": dim})


def test_lookup_in_an_empty_table_misses_and_files_become_views(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, name string")
    find = act("lookup", {"select": ["name"], "fromDBTable": "dim", "where": "k", "equals": "key", "onFail": [MISS]})
    assert "miss" in run(spark, items([find]), {"key": "1"}, tables={"dim": empty})[0][0]
    (tmp_path / "dim.json").write_text('{"k": "1", "name": "one", "n": 3}\n')
    find = act("lookup", {"select": ["name", "n"], "fromDBTable": "dimfile", "fromFile": str(tmp_path / "dim.json"), "where": "k", "equals": "key"})
    out = run(spark, items([find]), {"key": "1"})[0][0]
    assert (out["name"], out["n"]) == ("one", "3") and spark.table("dimfile").count() == 1
    values = spark.createDataFrame([("1",), ("2",)], "x string")
    assert sorted(map(tuple, lookup(spark.table("dimfile"), "k", values, "x", ["name"]).collect())) == [("1", "one"), ("2", None)]


def test_one_join_for_lookups_that_agree(spark):
    dim = spark.createDataFrame([("1", "one", "x")], "k string, name string, other string")
    one = {"fromDBTable": "dim", "where": "k", "equals": "key"}
    config = items([act("lookup", one | {"select": ["name"], "onPass": [act("lookup", one | {"select": ["other"]})]})])
    df = process_table(spark.createDataFrame([("1",)], "key string"), config, tables={"dim": dim})
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert requirements(C.parse(config).nodes)["dim"].columns == ("k", "name", "other")


def test_jdbc_lookup(spark):
    url = "jdbc:derby:memory:sieveworktest;create=true"
    spark.createDataFrame([(1, 9, "1"), (2, 9, "2"), (2, 9, "3"), (3, 9, None)], "k int, z int, v string").write.jdbc(url, "dim", mode="overwrite")
    find = act("jdbc-lookup", {"jdbcClient": "db", "select": ["V"], "fromDBTable": "dim", "where": "k = '$input.key' AND z = '$enriched.zone'", "onPass": [ADD], "onFail": [act("reject", {"reasonFrom": "jdbc-lookup"})]})
    config = items([act("add-enriched-field", [{"key": "zone", "value": "9"}]), find])
    got = {g[0]["key"]: g for g in run(spark, config, {"key": "1"}, {"key": "2"}, {"key": "3"}, {"key": "4"}, clients=[JdbcClient("db", url)])}
    assert got["1"][0]["V"] == "1" and "hit" in got["1"][0]
    assert [got[k][1] for k in "234"] == [["more than one row found"], ["null in a selected column"], ["no row found"]]
    with pytest.raises(ConfigError):
        run(spark, config, {"key": "1"}, clients=[])


def test_custom_actions_come_first(spark):
    def creator(kind, config):
        if kind == "shout":
            return C.Custom(lambda state, g: state.put("enriched", g, "loud", F.upper(state.records.slot(config["field"]).value)))
        return C.Nothing() if kind == "copy" else None

    out = run(spark, items([act("shout", {"field": "a"}), act("copy", "anything")]), {"a": "x"}, creators=[creator])[0][0]
    assert out["loud"] == "X"


def test_row_actions(spark):
    def shout(record, enriched):
        if record.get("a") == "bad":
            raise ValueError("bad a")
        return {"updates": {"loud": (record.get("a") or "").upper(), "undeclared": "x"}, "reason": "loud" if enriched.get("pre") else None, "stop": record.get("a") == "stop"}

    creator = lambda kind, config: row_action(shout, ["loud"]) if kind == "shout" else None
    config = items([act("add-enriched-field", [{"key": "pre", "value": "1"}]), act("shout"), ADD]) | {"global": {"exceptionHandlingList": [act("reject", {"reasonFrom": "unhandled-exception", "stopProcessingActionList": False}), act("add-rejection-reason", {"field": "why"})]}}
    got = {g[0]["a"]: g for g in run(spark, config, {"a": "x"}, {"a": "stop"}, {"a": "bad"}, creators=[creator])}
    assert got["x"][0]["loud"] == "X" and "hit" in got["x"][0] and "undeclared" not in got["x"][0] and got["x"][1] == ["loud"]
    assert got["stop"][0]["loud"] == "STOP" and "hit" not in got["stop"][0]
    assert got["bad"][0] == {"why": "ValueError: bad a", "a": "bad"}


def test_table_and_json_agree(spark):
    rows = [("1", "x", None), ("2", "", "q")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    config = items([act("check", {"field": "b", "op": "empty", "onPass": [act("reject", {"reason": "no b", "stopProcessingActionList": False}), act("add-rejection-reason", {"field": "why"})]}), act("replace-null", {"field": "c", "newValue": "n"})])
    wide = [{k: v for k, v in r.asDict().items() if v is not None} for r in process_table(df, config).collect()]
    maps = [{k: v for k, v in e.items() if v is not None} for e, _ in run(spark, config, *[dict(zip("abc", r, strict=True)) for r in rows])]
    assert wide == maps


@pytest.mark.parametrize(
    "bad",
    [
        act("nope"),
        act("copy", []),
        act("copy", [{"inputSource": "a"}]),
        act("simple-copy", {"inputSource": []}),
        act("check", {"field": "a", "op": "empty"}),
        act("check", {"field": "a", "op": "odd", "onPass": [ADD]}),
        act("check", {"left": "a", "op": "less", "right": "b", "onPass": [ADD]}),
        act("lookup", {"select": [], "fromDBTable": "t", "where": "k", "equals": "e"}),
        act("lookup", {"select": ["a"], "fromDBTable": "t", "where": "k", "equals": " "}),
        act("jdbc-lookup", {"jdbcClient": "c", "select": ["a"], "fromDBTable": "t", "where": "k > '1'", "onPass": [ADD]}),
        act("reject", {}),
        act("reject", {"reason": "a", "reasonFrom": "b"}),
        act("reject", {"reason": " "}),
        act("replace-null", {"field": "a", "newValue": ""}),
        act("replace-null", {"field": "a", "fields": ["b"], "newValue": "x"}),
        act("search-and-replace", {"inputSource": ["a"], "searchFor": "x", "replaceWith": ""}),
        act("add-rejection-reason", {"field": ""}),
        act("add-scratch-to-enriched", {"fields": [""]}),
    ],
)
def test_bad_configurations(bad):
    with pytest.raises(ConfigError):
        C.parse(items([bad]))


def test_more_bad_configurations():
    for bad in ({"items": [{}]}, {"items": [{"actions": []}]}, {"items": [{"actions": [None]}]}, []):
        with pytest.raises(ConfigError):
            C.parse(bad)
    assert isinstance(C.parse(items([act("reject", [{"reason": "x"}])])).nodes[0], C.Reject)


def test_addresses():
    assert Source.parse("a") == Source("enriched-then-input", "a") and Source.parse("$input.a", "enriched") == Source("input", "a")
    for bad in ("", None, "$nowhere.a", "$input.a.b", "$input", "$input."):
        with pytest.raises(ConfigError):
            Source.parse(bad)


def _random_actions(r: random.Random, depth: int = 0) -> list[dict]:
    f = lambda: r.choice("abcd")
    out = []
    for _ in range(r.randint(1, 3)):
        kind = r.choice(["copy", "simple-copy", "add", "check", "equals", "reject", "why", "null", "search", "lookup", "scratch"])
        nested = {"onPass": _random_actions(r, depth + 1), "onFail": _random_actions(r, depth + 1)} if depth < 2 else {"onPass": [ADD]}
        out.append(
            {
                "copy": lambda: act("copy", [{"inputSource": f(), "outputTarget": f()}]),
                "simple-copy": lambda: act("simple-copy", {"inputSource": [f(), f()]}),
                "add": lambda: act("add-enriched-field", [{"key": f(), "value": r.choice(["x", "", "1"])}]),
                "check": lambda: act("check", {"field": f(), "op": r.choice(["empty", "not-empty", "null", "non-null", "numeric", "non-numeric"])} | nested),
                "equals": lambda: act("check", {"left": f(), "op": "equals", "right": r.choice([f(), "$constant.X", "$input.a", "$scratchpad.b"]), "caseSensitive": r.random() < 0.5} | nested),
                "reject": lambda: act("reject", r.choice([{"reason": "r1"}, {"reason": "r2", "stopProcessingActionList": False}, {"reasonFrom": "lookup", "stopProcessingActionList": False}])),
                "why": lambda: act("add-rejection-reason", {"field": r.choice(["why", "a"])}),
                "null": lambda: act("replace-null", {"field": f(), "newValue": "nn", "outputTo": r.choice(["enriched", "scratchpad"])}),
                "search": lambda: act("search-and-replace", {"inputSource": [f()], "searchFor": "x", "replaceWith": "yy"}),
                "lookup": lambda: act("lookup", {"select": ["name", "b"], "fromDBTable": "dim", "where": "k", "equals": f()} | nested),
                "scratch": lambda: act("add-scratch-to-enriched", {"fields": [f()]}),
            }[kind]()
        )
    return out


@pytest.mark.parametrize("seed", range(12))
def test_random_configurations_against_the_interpreter(spark, seed):
    r = random.Random(seed)
    config = items(*[_random_actions(r) for _ in range(r.randint(1, 3))])
    records = [{k: r.choice([None, "", "x", "X", "1", "2.5", 3, True]) for k in "abcde" if r.random() < 0.75} for _ in range(25)]
    dim = {"x": {"name": "nx", "b": "bx"}, "1": {"name": "n1", "b": None}}
    df = spark.createDataFrame([(k, v["name"], v["b"]) for k, v in dim.items()], "k string, name string, b string")
    lines = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "i int, value string").coalesce(1)
    got = [(dict(g.enriched), list(g.reasons)) for g in Pipeline.of(config, tables={"dim": df}).over_json(lines).collect()]
    want = [w for w in (process(config, x, {"dim": dim}) for x in records) if w[0]]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_line_is_parsed_once(spark):
    from sievework import queries

    events = "/root/testdata/sf0.001"
    if not __import__("pathlib").Path(events).exists():
        pytest.skip("needs the test tables")
    for name in ("exception_handler", "json_lines"):
        plan = queries.QUERIES[name](spark, events)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, name


def test_conditions_of_jdbc_lookups():
    from sievework.plans import config as C

    def parsed(where):
        return C.parse(items([act("jdbc-lookup", {"jdbcClient": "c", "select": ["a"], "fromDBTable": "t", "where": where, "onPass": [ADD]})])).items[0].actions[0]

    plain = parsed("a = '$input.x' AND b = 'constant'")
    assert [k for k, _ in plain.keys] == ["a", "b"] and plain.condition is None
    wide = parsed("a > '$input.x' or upper(b) in ('{', $enriched.y)")
    assert wide.keys == () and wide.condition == "a > {0} or upper(b) in ('{{', {1})" and [(v.location, v.name) for v in wide.values] == [("input", "x"), ("enriched", "y")]
