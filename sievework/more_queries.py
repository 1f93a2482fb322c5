"""Queries for sources, sinks, lookups, plugged-in parts and the toolbox, one for each, with SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .engine import AUTO_COPIED, UNHANDLED, JdbcClient, Pipeline, process_dir, process_json_strings, process_table
from .errors import ConfigError
from .functions import schema as sch
from .functions.convert import ltrim, rtrim
from .functions.schema import Field, Schema
from .operators import frame, typing
from .operators.actions import row_action
from .operators.checks import true_checker
from .plans import config as C
from .plans import lookups
from .queries import _lookup, act, add, items, query, run, shared_folder, table
from .sources import derby, files, sink

KEYS = ("event_id", "event_type")


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def _folder(spark: SparkSession, df: DataFrame, name: str, format: str = "text") -> str:
    path = shared_folder(spark, name)
    df.write.format(format).save(path)
    return path


def _facts(spark: SparkSession, **facts) -> DataFrame:
    """What a function on the driver has given, as rows (name, value)."""
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in facts.items()], "name string, value string")


def _values(**facts) -> str:
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in facts.items()]
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows) + ") t(name, value)"


def refused(make) -> str:
    """What a ConfigError says."""
    try:
        make()
    except ConfigError as error:
        return str(error)
    return "not refused"


# Sources


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, 'event_id,event_type' AS copied FROM events")
def json_folder(spark, d):
    path = _folder(spark, _lines(table(spark, d, "events").select(*KEYS)), "lines")
    out = typing.to_string_columns(process_dir(spark, path, {}), [*KEYS, AUTO_COPIED])
    return out.withColumnRenamed(AUTO_COPIED, "copied")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name AS name FROM region")
def json_in_memory(spark, d):
    lines = [json.dumps({"r_regionkey": r.r_regionkey, "r_name": r.r_name}) for r in table(spark, d, "region").collect()]
    config = items([act("copy", [{"inputSource": "r_name", "outputTarget": "name"}]), act("simple-copy", {"inputSource": ["r_regionkey"]})])
    return typing.to_string_columns(process_json_strings(spark, lines, config), ["r_regionkey", "name"])


@query("""SELECT CASE WHEN event_id % 3 = 2 THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN event_id % 3 <> 2 THEN 'turned away' END AS outcome,
CASE event_id % 3 WHEN 0 THEN 'not a JSON object: no json ' || event_id WHEN 1 THEN 'not a JSON object: [' || event_id || ']' END AS why FROM events""")
def malformed_lines(spark, d):
    df = table(spark, d, "events").select(F.expr("CASE event_id % 3 WHEN 0 THEN 'no json ' || event_id WHEN 1 THEN '[' || event_id || ']' ELSE to_json(named_struct('event_id', event_id)) END AS value"))
    config = items([act("simple-copy", {"inputSource": ["event_id"]})], on_error=[add(outcome="turned away"), act("reject", {"reasonFrom": UNHANDLED})])
    out = Pipeline.of(config, malformed="error").over_json(df)
    return out.select(F.element_at("enriched", F.lit("event_id")).alias("event_id"), F.element_at("enriched", F.lit("outcome")).alias("outcome"), F.get("reasons", F.lit(0)).alias("why"))


@query("SELECT 'seen' AS state FROM events WHERE event_type = 'click'")
def empty_records_go(spark, d):
    check = act("check", {"left": "event_type", "op": "equals", "right": "$constant.click", "onPass": [add(state="seen")]})
    out = Pipeline.of(items([check])).over_json(_lines(table(spark, d, "events").select(*KEYS)), auto_copy=False)
    return typing.to_string_columns(out, ["state"])


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, 'fixed text' AS note FROM supplier")
def text_files(spark, d):
    path = files.write_temp_file("fixed\n text\n", ".txt")
    text = files.file_to_string(files.write_file(files.file_to_string(path), path))
    return process_table(table(spark, d, "supplier").select("s_suppkey"), items([add(note=text)])).select("s_suppkey", "note")


# Lookups


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_in_catalog(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("sievework_nation")
    return run(table(spark, d, "supplier"), items([_lookup(["n_name"], "n_nationkey", "s_nationkey", "sievework_nation")]), "s_suppkey", "n_name")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_in_file(spark, d):
    path = _folder(spark, table(spark, d, "nation"), "nation", "json")
    find = act("lookup", {"select": ["n_name"], "fromDBTable": "dim.nation", "fromFile": path, "where": "n_nationkey", "equals": "s_nationkey"})
    return run(table(spark, d, "supplier"), items([find]), "s_suppkey", "n_name")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, a.n_name, CAST(b.n_regionkey AS VARCHAR) AS n_regionkey
FROM supplier LEFT JOIN nation a ON s_nationkey = a.n_nationkey LEFT JOIN nation b ON b.n_name = a.n_name AND s_suppkey % 2 = 0""")
def lookup_two_keys(spark, d):
    nation = table(spark, d, "nation")
    names = nation.select(F.col("n_nationkey").alias("__k"), F.col("n_name").alias("name"))
    df = table(spark, d, "supplier").join(names, F.col("s_nationkey") == F.col("__k"), "left").select("s_suppkey", "s_nationkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN name END AS name"))
    config = items([_lookup(["n_name"], "n_nationkey", "s_nationkey", "nation"), _lookup(["n_regionkey"], "n_name", "name", "nation")])
    return run(df, config, "s_suppkey", "n_name", "n_regionkey", tables={"nation": nation})


@query("SELECT s_suppkey, s_nationkey::VARCHAR AS place, n_name, n_regionkey::VARCHAR AS n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup_rows(spark, d):
    values = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("place"))
    keyed = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    return lookups.lookup(keyed, "n_nationkey", values, "place", ["n_name", "n_regionkey"])


@query(_values(planned=["n_name", "n_nationkey", "n_regionkey"], without="no such table: 'nowhere'; give it with tables, in the catalog, or as a file"))
def lookup_planning(spark, d):
    """The columns that all lookups in a table need, and a table that isn't there."""
    program = C.parse(items([_lookup(["n_name"], "n_nationkey", "a", "nation"), _lookup(["n_regionkey"], "n_name", "b", "nation")]))
    needed = sorted(lookups.requirements(program.nodes)["nation"].columns)
    return _facts(spark, planned=needed, without=refused(lambda: run(table(spark, d, "region"), items([_lookup(["x"], "y", "r_name", "nowhere")]), "r_name")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CASE WHEN n = 1 THEN found END AS n_name, CASE n WHEN 0 THEN 'no row found' WHEN 1 THEN NULL ELSE 'more than one row found' END AS why
FROM (SELECT s_suppkey, count(n_name) AS n, min(n_name) AS found FROM supplier LEFT JOIN nation ON n_nationkey >= s_nationkey AND n_nationkey <= s_nationkey + s_suppkey % 3 - 1 OR upper(n_name) = 'no ' || s_suppkey GROUP BY 1)""")
def jdbc_lookup_any_where(spark, d):
    """A condition with ranges, or, and a function; values that several records share are asked for once."""
    url = derby.packed(table(spark, d, "nation"), "nation", f"{shared_folder(spark, 'nation')}.jar")
    where = "n_nationkey >= '$input.s_nationkey' AND n_nationkey <= $input.top OR upper(n_name) = concat('no ', $input.s_suppkey)"
    find = act("jdbc-lookup", {"jdbcClient": "db", "select": ["N_NAME"], "fromDBTable": "nation", "where": where, "onFail": [act("reject", {"reasonFrom": "jdbc-lookup"})]})
    df = table(spark, d, "supplier").withColumn("top", F.expr("s_nationkey + s_suppkey % 3 - 1"))
    client = JdbcClient("db", url, split={"nation": ("n_nationkey", 0, 25, 3)})
    out = run(df, items([find], [act("add-rejection-reason", {"field": "why"})]), "s_suppkey", "N_NAME", "why", clients=[client])
    return out.withColumnRenamed("N_NAME", "n_name")


# Actions and checks


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, 'kept' AS mark FROM nation")
def null_action(spark, d):
    return run(table(spark, d, "nation"), items([act("null", {"name": "placeholder"}), add(mark="kept")]), "n_nationkey", "mark")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 'number' ELSE 'other' END AS kind FROM part")
def check_non_numeric_branch(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 1 THEN p_size || 'x' WHEN 2 THEN string(p_retailprice) END AS size"))
    return run(df, items([act("check", {"field": "size", "op": "non-numeric", "onPass": [add(kind="other")], "onFail": [add(kind="number")]})]), "p_partkey", "kind")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS flagged FROM customer")
def check_true(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.expr("CASE c_custkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'truth' END AS flag"))
    config = items([act("check", {"field": "flag", "op": "true", "onPass": [add(flagged="yes")], "onFail": [add(flagged="no")]})])
    return run(df, config, "c_custkey", "flagged", checkers={"true": true_checker})


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN starts_with(c_mktsegment, 'B') THEN 'b' WHEN len(c_mktsegment) > len(c_name) THEN 'longer' ELSE 'rest' END AS kind FROM customer")
def check_custom(spark, d):
    """Predicates of the user's, over one field and over two."""
    longer = act("check", {"left": "c_mktsegment", "op": "longer-than", "right": "c_name", "onPass": [add(kind="longer")], "onFail": [add(kind="rest")]})
    config = items([act("check", {"field": "c_mktsegment", "op": "b-word", "onPass": [add(kind="b")], "onFail": [longer]})])
    checkers = {"b-word": lambda left, _: left.value.startswith("B"), "longer-than": lambda left, right: F.length(left.value) > F.length(right.value)}
    return run(table(spark, d, "customer"), config, "c_custkey", "kind", checkers=checkers)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, upper(n_name) AS loud FROM nation")
def custom_action(spark, d):
    def shout(kind: str, config):
        if kind != "shout":
            return None
        return C.Custom(lambda state, g: state.put("enriched", g, config["to"], F.upper(state.records.slot(config["from"]).value)))

    return run(table(spark, d, "nation"), items([act("shout", {"from": "n_name", "to": "loud"})]), "n_nationkey", "loud", creators=[shout])


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN reverse(n_name) END AS back, CASE WHEN n_nationkey % 2 = 1 THEN 'odd' END AS why FROM nation""")
def custom_row_action(spark, d):
    """An action in plain Python."""
    def back(record: dict, enriched: dict) -> dict:
        return {"updates": {"back": record["n_name"][::-1]}} if int(record["n_nationkey"]) % 2 == 0 else {"reason": "odd", "stop": True}

    creators = [lambda kind, config: row_action(back, ["back"]) if kind == "back" else None]
    return run(table(spark, d, "nation"), items([act("back", {})], [act("add-rejection-reason", {"field": "why"})]), "n_nationkey", "back", "why", creators=creators)


BAD = {
    "no actions": {"items": [{"actions": []}]},
    "null action": {"items": [{"actions": [None]}]},
    "unknown action": items([act("fly", {})]),
    "blank text": items([act("add-rejection-reason", {"field": " "})]),
    "no list": items([act("simple-copy", {"inputSource": "a"})]),
    "no flag": items([act("reject", {"reason": "r", "stopProcessingActionList": "yes"})]),
    "where": items([act("jdbc-lookup", {"jdbcClient": "c", "select": ["a"], "fromDBTable": "t", "where": "k > '1'", "onPass": [add(a="b")]})]),
}
REFUSALS = {
    "no actions": "an item needs a list of actions",
    "null action": "an action is an object",
    "unknown action": "no such action: 'fly'",
    "blank text": "add-rejection-reason: 'field' must be a string with something in it",
    "no list": "simple-copy must be a list of strings with something in them",
    "no flag": "reject: 'stopProcessingActionList' must be true or false",
    "where": "jdbc-lookup: where must refer to a value of the record, as in column = '$location.field': \"k > '1'\"",
}


@query(_values(**REFUSALS))
def refused_configurations(spark, d):
    return _facts(spark, **{k: refused(lambda c=c: C.parse(c)) for k, c in BAD.items()})


# Schemas and sinks

NATION = Schema("nation", (Field("n_nationkey", S.LongType(), False, 0), Field("n_name", S.StringType(), True, ""), Field("weight", S.DoubleType(), True, 2.5, "a weight"), Field("big", S.BooleanType(), True, None)))


def _schema_file(spark: SparkSession, text: str) -> str:
    return _folder(spark, spark.createDataFrame([(text,)], "value string").coalesce(1), "schema")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 2.5::DOUBLE AS weight, NULL::BOOLEAN AS big FROM nation WHERE n_nationkey % 5 <> 0")
def avro_by_schema_path(spark, d):
    """Enriched records to Avro by a schema that is read from a file; records with a key that is no number come back."""
    path = shared_folder(spark, "avro")
    lines = _lines(table(spark, d, "nation").select(F.expr("CASE WHEN n_nationkey % 5 = 0 THEN 'n' || n_nationkey ELSE string(n_nationkey) END AS n_nationkey"), "n_name"))
    config = items([act("simple-copy", {"inputSource": ["n_nationkey", "n_name"]})])
    sink.write_enriched(Pipeline.of(config).over_json(lines), _schema_file(spark, NATION.to_json()), path)
    return sink.read(spark, path)


WANTED = S.StructType([S.StructField("n_name", S.StringType()), S.StructField("n_nationkey", S.LongType()), S.StructField("note", S.StringType())])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, NULL::VARCHAR AS note FROM nation WHERE n_nationkey % 4 <> 1")
def conforming_write(spark, d):
    path = shared_folder(spark, "avro")
    df = table(spark, d, "nation").select(F.expr("CASE WHEN n_nationkey % 4 = 1 THEN 'odd' ELSE string(n_nationkey) END AS n_nationkey"), "n_name", "n_regionkey")
    sink.write_conforming(df, WANTED, path, strict=True)
    return sink.read(spark, path)


@query("SELECT 'odd' AS n_nationkey, n_name, 'could not convert value in field ''n_nationkey'' to ''LongType'': ''odd''' AS why FROM nation WHERE n_nationkey % 4 = 1")
def conforming_write_errors(spark, d):
    df = table(spark, d, "nation").select(F.expr("CASE WHEN n_nationkey % 4 = 1 THEN 'odd' ELSE string(n_nationkey) END AS n_nationkey"), "n_name")
    errors = sink.write_conforming(df, WANTED, shared_folder(spark, "avro"), strict=True)
    return frame.add_change_errors_to(errors, "why")


@query(_values(read=["n_nationkey:bigint:False:0", "n_name:string:True:", "weight:double:True:2.5", "big:boolean:True:None"], text=["0", "", "2.5", None], doc="a weight", typed=2.5, wrong="the default of field 'weight' is no str", float="field 'f': an output field can't be float"))
def schema_from_file(spark, d):
    """A schema by its path: types, nullability, defaults as they are, typed and in words."""
    schema = sch.load_schema(spark, _schema_file(spark, NATION.to_json()))
    weight = schema.field("weight")
    other = Schema("f", (Field("f", S.FloatType(), False, 0.5),))
    return _facts(
        spark,
        read=[f"{f.name}:{f.type.simpleString()}:{f.nullable}:{f.default}" for f in schema.fields],
        text=[f.default_text() for f in schema.fields],
        doc=weight.doc,
        typed=weight.default_as(float),
        wrong=refused(lambda: weight.default_as(str)),
        float=refused(other.check_output),
    )


STRINGS = {"type": "record", "name": "nation", "fields": [{"name": "n_nationkey", "type": ["string"], "default": "0"}, {"name": "n_name", "type": ["null", "string"], "default": ""}, {"name": "weight", "type": ["null", "string"], "doc": "a weight", "default": "2.5"}, {"name": "big", "type": ["null", "string"], "default": None}]}


@query(_values(file=json.dumps(STRINGS), fields=["n_nationkey:False:0", "n_name:True:", "weight:True:2.5", "big:True:None"], forced=[True] * 4, struct=["string"] * 4, struct_nullable=[False, True, True, True], struct_forced=[True] * 4))
def string_schema(spark, d):
    """A schema with strings for all types: as a file, as fields, as a structure."""
    source = files.write_temp_file(NATION.to_json())
    target = files.write_temp_file("")
    sch.stringify_schema_file(source, target)
    struct = sch.struct_from(NATION.fields)
    return _facts(
        spark,
        file=files.file_to_string(target),
        fields=[f"{f.name}:{f.nullable}:{f.default}" for f in NATION.as_strings().fields],
        forced=[f.nullable for f in NATION.as_strings(force_nullable=True).fields],
        struct=[f.dataType.simpleString() for f in sch.all_string_struct(struct).fields],
        struct_nullable=[f.nullable for f in sch.all_string_struct(struct, force_nullable=False).fields],
        struct_forced=[f.nullable for f in sch.all_string_struct(struct).fields],
    )


# Toolbox


@query(_values(there="int", gone="None", taken="there is a column 'n_name' already", empty="[True, False]", null="[True, True, False]"))
def column_facts(spark, d):
    nation = table(spark, d, "nation")
    row = nation.select("n_name", F.lit(None).cast("string").alias("note")).first()
    return _facts(
        spark,
        there=frame.data_type(nation, "n_nationkey").simpleString(),
        gone=str(frame.data_type(nation, "nothing")),
        taken=refused(lambda: frame.add_column_with_default(nation, Field("n_name", S.StringType(), True, ""))),
        empty=str([frame.is_empty(nation.limit(0)), frame.is_empty(nation)]),
        null=str([sch.field_is_null(row, "note"), sch.field_is_null(row, "nothing"), sch.field_is_null(row, "n_name")]),
    )


@query("SELECT r_regionkey, r_name, 7::BIGINT AS size FROM region")
def column_with_default(spark, d):
    return frame.add_column_with_default(table(spark, d, "region"), Field("size", S.LongType(), False, 7))


@query("SELECT n_nationkey, n_name FROM nation WHERE FALSE")
def empty_frame(spark, d):
    return frame.empty_frame(spark, table(spark, d, "nation").select("n_nationkey", "n_name").schema)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b, n_name AS c FROM nation")
def merged_maps(spark, d):
    addition = F.expr("CASE WHEN n_nationkey % 2 = 0 THEN map('a', 'new', 'c', n_name) ELSE map('c', n_name) END")
    both = frame.merge_maps(addition, F.expr("map('a', 'old', 'b', 'kept')"))
    return table(spark, d, "nation").select("n_nationkey", both.alias("m")).select("n_nationkey", *[F.element_at("m", F.lit(k)).alias(k) for k in "abc"])


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def repartitioned_rows(spark, d):
    """To more partitions, then to fewer, with every row."""
    df = frame.repartitioned(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 24)
    return frame.repartitioned(df, 5)


@query("SELECT c_custkey, c_name || '  ' AS left_side, '  ' || c_name AS right_side FROM customer")
def trimmed_sides(spark, d):
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit("  "))
    return table(spark, d, "customer").select("c_custkey", ltrim(padded).alias("left_side"), rtrim(padded).alias("right_side"))


@query("SELECT key, count(*) AS records FROM (SELECT unnest(['event_id', 'event_type']) AS key FROM events UNION ALL SELECT 'late' FROM events WHERE event_id % 2 = 0) GROUP BY key")
def keys_that_occur(spark, d):
    """A string column for each key that any record has."""
    df = table(spark, d, "events").select(F.expr("CASE WHEN event_id % 2 = 0 THEN to_json(named_struct('event_id', event_id, 'event_type', event_type, 'late', 'y')) ELSE to_json(named_struct('event_id', event_id, 'event_type', event_type)) END AS value"))
    wide = typing.to_string_columns(Pipeline.of({}).over_json(df)).drop(AUTO_COPIED)
    return wide.select(F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in wide.columns])).alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("records"))
