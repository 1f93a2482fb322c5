"""Queries over the test tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .engine import AUTO_COPIED, JdbcClient, Pipeline
from .functions.convert import TrimConfig
from .functions.schema import Field, Schema
from .operators import frame, typing
from .sources import derby, sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def act(kind: str, config: Any) -> dict:
    return {"actionType": kind, "config": config}


def items(*lists: list[dict], on_error: list[dict] | None = None) -> dict:
    return {"items": [{"actions": x} for x in lists]} | ({"global": {"exceptionHandlingList": on_error}} if on_error else {})


def add(**fields: str) -> dict:
    return act("add-enriched-field", [{"key": k, "value": v} for k, v in fields.items()])


def run(df: DataFrame, config: dict, *columns: str, **more: Any) -> DataFrame:
    return Pipeline.of(config, **more).over_table(df).select(*columns)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def simple_copy(spark, d):
    return run(table(spark, d, "customer"), items([act("simple-copy", {"inputSource": ["c_custkey", "c_name"]})]), "c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_name AS customer, c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")
def copy_rename(spark, d):
    pairs = [{"inputSource": "c_name", "outputTarget": "customer"}, {"inputSource": "c_mktsegment", "outputTarget": "segment"}]
    return run(table(spark, d, "customer"), items([act("copy", pairs)]), "customer", "segment", "c_custkey")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, 'second' AS kind, 'x' AS mark FROM nation")
def add_fields(spark, d):
    return run(table(spark, d, "nation"), items([add(kind="first", mark="x"), add(kind="second")]), "n_nationkey", "kind", "mark")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'full' ELSE 'empty' END AS state FROM orders")
def check_empty_branch(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 2 THEN 'n' END AS note"))
    return run(df, items([act("check", {"field": "note", "op": "empty", "onPass": [add(state="empty")], "onFail": [add(state="full")]})]), "o_orderkey", "state")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 4 IN (2, 3) THEN 'y' ELSE 'n' END AS numeric FROM part")
def check_numeric_branch(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN 'x' || p_size WHEN 1 THEN p_size || 'd' WHEN 2 THEN p_size || '.5' ELSE string(p_size) END AS size"))
    return run(df, items([act("check", {"field": "size", "op": "numeric", "onPass": [add(numeric="y")], "onFail": [add(numeric="n")]})]), "p_partkey", "numeric")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN '1' ELSE '0' END AS builds FROM customer")
def check_equals_ci(spark, d):
    check = {"left": "c_mktsegment", "op": "equals", "right": "$constant.bUILDING", "caseSensitive": False, "onPass": [add(builds="1")], "onFail": [add(builds="0")]}
    return run(table(spark, d, "customer"), items([act("check", check)]), "c_custkey", "builds")


def _lookup(select: list[str], where: str, equals: str, name: str, **branches: list[dict]) -> dict:
    return act("lookup", {"select": select, "fromDBTable": name, "where": where, "equals": equals} | branches)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_customer_nation(spark, d):
    config = items([_lookup(["n_name", "n_regionkey"], "n_nationkey", "c_nationkey", "nation")])
    return run(table(spark, d, "customer"), config, "c_custkey", "n_name", "n_regionkey", tables={"nation": table(spark, d, "nation")})


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, c_name, CASE WHEN c_custkey IS NULL THEN 'Invalid c_custkey: ''' || o_custkey || '''' END AS why
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 - o_custkey END AS o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey""")
def lookup_miss_reject(spark, d):
    """Every other order asks for a customer that isn't there."""
    config = items([_lookup(["c_name"], "c_custkey", "o_custkey", "customer", onFail=[act("reject", {"reasonFrom": "lookup"})])], [act("add-rejection-reason", {"field": "why"})])
    df = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 - o_custkey END AS o_custkey"))
    return run(df, config, "o_orderkey", "c_name", "why", tables={"customer": table(spark, d, "customer")})


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, n_name, r_name, CASE WHEN r_regionkey IS NULL THEN 'nowhere' END AS region_state
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON s_nationkey % 7 = r_regionkey""")
def nested_lookup(spark, d):
    inner = _lookup(["r_name"], "r_regionkey", "zone", "region", onFail=[add(region_state="nowhere")])
    config = items([_lookup(["n_name"], "n_nationkey", "s_nationkey", "nation", onPass=[inner])])
    df = table(spark, d, "supplier").withColumn("zone", F.col("s_nationkey") % 7)
    return run(df, config, "s_suppkey", "n_name", "r_name", "region_state", tables={t: table(spark, d, t) for t in ("nation", "region")})


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
NULLIF(concat_ws('; ', CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_linestatus = 'F' THEN 'finished' END), '') AS why FROM lineitem""")
def multi_reject(spark, d):
    def check(field: str, value: str, reason: str) -> dict:
        return act("check", {"left": field, "op": "equals", "right": f"$constant.{value}", "onPass": [act("reject", {"reason": reason, "stopProcessingActionList": False})]})

    config = items([check("l_returnflag", "R", "returned"), check("l_linestatus", "F", "finished"), act("add-rejection-reason", {"field": "why"})])
    return run(table(spark, d, "lineitem"), config, "l_orderkey", "l_linenumber", "why")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'yes' END AS same_list, 'yes' AS next_item,
CASE WHEN o_orderstatus = 'F' THEN 'stopped' END AS why FROM orders""")
def stop_vs_continue(spark, d):
    stop = act("check", {"left": "o_orderstatus", "op": "equals", "right": "$constant.F", "onPass": [act("reject", {"reason": "stopped"})]})
    config = items([stop, add(same_list="yes")], [add(next_item="yes"), act("add-rejection-reason", {"field": "why"})])
    return run(table(spark, d, "orders"), config, "o_orderkey", "same_list", "next_item", "why")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'click' THEN 'none' ELSE event_type END AS kind FROM events")
def replace_null(spark, d):
    df = table(spark, d, "events").select("event_id", F.expr("nullif(event_type, 'click') AS kind"))
    return run(df, items([act("replace-null", {"field": "kind", "newValue": "none"})]), "event_id", "kind")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, regexp_replace(p_brand, '[0-9]', '#', 'g') AS p_brand FROM part")
def search_replace(spark, d):
    return run(table(spark, d, "part"), items([act("search-and-replace", {"inputSource": ["p_brand"], "searchFor": "[0-9]", "replaceWith": "#"})]), "p_partkey", "p_brand")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, 'given' AS batch, CASE WHEN event_type = 'view' THEN 'unseen' ELSE event_type END AS kind FROM events")
def scratch_to_enriched(spark, d):
    df = table(spark, d, "events").select("event_id", F.expr("nullif(event_type, 'view') AS kind"))
    config = items([act("replace-null", {"field": "kind", "newValue": "unseen", "outputTo": "scratchpad"}), act("add-scratch-to-enriched", {"fields": ["batch", "kind", "missing"]})])
    return run(df, config, "event_id", "batch", "kind", scratch={"batch": "given"})


@query(f"SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name, 'r_name' AS {AUTO_COPIED} FROM region")
def autocopy_marker(spark, d):
    return run(table(spark, d, "region"), items([act("simple-copy", {"inputSource": ["r_regionkey"]})]), "r_regionkey", "r_name", AUTO_COPIED)


@query("""SELECT CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN event_type = 'error' THEN 'caught' END AS outcome,
CASE WHEN event_type = 'error' THEN 'null in the scratchpad under ''hole''' END AS why FROM events""")
def exception_handler(spark, d):
    fail = act("check", {"left": "event_type", "op": "equals", "right": "$constant.error", "onPass": [act("add-scratch-to-enriched", {"fields": ["hole"]})]})
    caught = [add(outcome="caught"), act("reject", {"reasonFrom": "unhandled-exception", "stopProcessingActionList": False}), act("check", {"field": "outcome", "op": "not-empty", "onPass": [act("copy", [{"inputSource": "nothing", "outputTarget": "unused"}])]})]
    df = table(spark, d, "events").select("event_id", "event_type")
    pipeline = Pipeline.of(items([fail], on_error=caught), scratch={"hole": None})
    lines = df.select(F.to_json(F.struct("*")).alias("value"))
    out = pipeline.over_json(lines)
    return out.select(F.element_at("enriched", F.lit("event_id")).alias("event_id"), F.element_at("enriched", F.lit("outcome")).alias("outcome"), F.get("reasons", F.lit(0)).alias("why"))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, user_id::VARCHAR AS user_id, event_type, 'event_id,event_type,props,user_id' AS copied FROM events""")
def json_lines(spark, d):
    lines = table(spark, d, "events").select("event_id", "user_id", "event_type", "props").select(F.to_json(F.struct("*")).alias("value"))
    out = typing.to_string_columns(Pipeline.of({}).over_json(lines), ["event_id", "user_id", "event_type", AUTO_COPIED])
    return out.withColumnRenamed(AUTO_COPIED, "copied")


TYPED = Schema("event", (Field("event_id", S.LongType(), False, 0), Field("amount", S.IntegerType(), True, 7), Field("ok", S.BooleanType(), True, False), Field("kind", S.StringType(), True, "")))


def _odd_events(spark: SparkSession, d: str) -> DataFrame:
    amount = "CASE event_id % 5 WHEN 0 THEN 'x' || user_id WHEN 1 THEN '' WHEN 2 THEN ' ' || user_id || ' ' WHEN 3 THEN user_id || 'L' ELSE string(user_id) END AS amount"
    ok = "CASE event_id % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' false ' END AS ok"
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.expr(amount), F.expr(ok), F.col("event_type").alias("kind"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 7 ELSE user_id END::INTEGER AS amount, event_id % 3 = 0 AS ok, event_type AS kind
FROM events WHERE event_id % 5 NOT IN (0, 3)""")
def typed_conversion_good(spark, d):
    return frame.set_defaults(typing.columns_to_typed(_odd_events(spark, d), TYPED, TrimConfig()).good, TYPED)


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, CASE event_id % 5 WHEN 0 THEN 'could not convert value ''x' || user_id || ''' in field ''amount'' to a ''IntegerType''.'
ELSE 'can''t convert ''' || user_id || 'L'' in field ''amount'' to IntegerType type. (No alphanumeric characters are allowed in numeric fields.)' END AS message FROM events WHERE event_id % 5 IN (0, 3)""")
def typed_conversion_errors(spark, d):
    return typing.columns_to_typed(_odd_events(spark, d), TYPED, TrimConfig()).errors.select("event_id", F.col(typing.TYPE_ERROR).alias("message"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'nobody' END AS c_name, 1.5::DOUBLE AS rate FROM customer")
def set_defaults(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name"))
    return frame.set_defaults(df, Schema("c", (Field("c_name", S.StringType(), True, "nobody"), Field("rate", S.DoubleType(), True, 1.5))))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, TRY_CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE 'q' END AS INTEGER) AS place, NULL::BIGINT AS extra FROM supplier")
def change_schema(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN string(s_nationkey) ELSE 'q' END AS place"), "s_name")
    return frame.change_schema(df, S.StructType([S.StructField("place", S.IntegerType()), S.StructField("s_suppkey", S.StringType()), S.StructField("extra", S.LongType())])).good


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, 'q' AS place, 'could not convert value in field ''place'' to ''IntegerType'': ''q''' AS why FROM supplier WHERE s_suppkey % 2 <> 0")
def change_schema_errors(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN string(s_nationkey) ELSE 'q' END AS place"))
    return frame.add_change_errors_to(frame.change_schema(df, S.StructType([S.StructField("s_suppkey", S.LongType()), S.StructField("place", S.IntegerType())]), strict=True).errors, "why")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def all_strings(spark, d):
    return frame.all_strings(table(spark, d, "nation"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def flatten_struct(spark, d):
    return frame.flatten(table(spark, d, "supplier").select("s_suppkey", F.struct("s_name", F.struct("s_nationkey").alias("b")).alias("a")))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def safe_union(spark, d):
    df = table(spark, d, "nation")
    return frame.safe_union(df.select("n_nationkey", "n_name"), df.filter("n_regionkey = 1").select("n_name", "n_nationkey"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def reorder_columns(spark, d):
    return frame.reorder_columns(table(spark, d, "nation"), ["n_regionkey", "n_nationkey", "n_name"])


@query("SELECT p_partkey, p_name FROM part")
def drop_prefix(spark, d):
    return frame.drop_fields_starting_with(table(spark, d, "part").selectExpr("p_partkey", "p_name", "p_size AS x_size", "p_type AS x_type"), "x_")


def _split(spark: SparkSession, d: str) -> frame.Split:
    return frame.split(table(spark, d, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'P') AS status"), F.col("status") == "F")


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'")
def split_positive(spark, d):
    return _split(spark, d).positive


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def split_negative(spark, d):
    return _split(spark, d).negative


@query("SELECT p_partkey, p_partkey % 3 = 0 AS flag FROM part")
def is_numeric(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.expr("CASE p_partkey % 3 WHEN 0 THEN '-0012345678901234567890' || p_size WHEN 1 THEN p_size || '.5' END AS text"))
    return frame.with_numeric_flag(df, "text", "flag").drop("text")


@query("SELECT r_regionkey, r_name, 'new' AS added FROM region")
def add_if_missing(spark, d):
    return frame.add_if_missing(frame.add_if_missing(table(spark, d, "region"), "added", F.lit("new")), "r_name", F.lit("never"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, n_name, CASE WHEN n_nationkey IS NULL THEN 'no row found' END AS why FROM supplier LEFT JOIN nation ON CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE -1 - s_nationkey END = n_nationkey")
def jdbc_lookup(spark, d):
    url = derby.packed(table(spark, d, "nation"), "nation", f"{shared_folder(spark, 'nation')}.jar")
    df = table(spark, d, "supplier").withColumn("place", F.expr("CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE -1 - s_nationkey END"))
    find = act("jdbc-lookup", {"jdbcClient": "db", "select": ["N_NAME"], "fromDBTable": "nation", "where": "n_nationkey = '$input.place'", "onFail": [act("reject", {"reasonFrom": "jdbc-lookup"})]})
    out = run(df, items([find], [act("add-rejection-reason", {"field": "why"})]), "s_suppkey", "N_NAME", "why", clients=[JdbcClient("db", url)])
    return out.withColumnRenamed("N_NAME", "n_name")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/sievework-{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 'none' AS note FROM nation")
def avro_round_trip(spark, d):
    path = shared_folder(spark, "avro")
    schema = Schema("nation", (Field("n_nationkey", S.LongType(), False, 0), Field("n_name", S.StringType(), True, ""), Field("note", S.StringType(), True, "none")))
    lines = table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    config = items([act("simple-copy", {"inputSource": ["n_nationkey", "n_name"]})])
    sink.write_enriched(Pipeline.of(config).over_json(lines), schema, path)
    return sink.read(spark, path)


FLAGSHIP = items(
    [
        act("simple-copy", {"inputSource": ["o_orderkey", "o_orderpriority"]}),
        _lookup(["c_name", "c_mktsegment"], "c_custkey", "o_custkey", "customer", onFail=[act("reject", {"reasonFrom": "lookup", "stopProcessingActionList": False})]),
        act("check", {"field": "quantity", "op": "numeric", "onPass": [act("copy", [{"inputSource": "quantity", "outputTarget": "amount"}])], "onFail": [act("reject", {"reason": "quantity is no number", "stopProcessingActionList": False})]}),
    ],
    [act("add-rejection-reason", {"field": "why"})],
)
ORDER = Schema("order", (Field("o_orderkey", S.LongType(), False, 0), Field("o_orderpriority", S.StringType(), True, ""), Field("c_name", S.StringType(), True, "unknown"), Field("c_mktsegment", S.StringType(), True, ""), Field("amount", S.IntegerType(), True, -1), Field("why", S.StringType(), True, "")))


@query("""SELECT o_orderkey, o_orderpriority, coalesce(c_name, 'unknown') AS c_name, coalesce(c_mktsegment, '') AS c_mktsegment,
CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE (o_orderkey % 50)::INTEGER END AS amount,
concat_ws('; ', CASE WHEN c_custkey IS NULL THEN 'Invalid c_custkey: ''' || o_custkey || '''' END, CASE WHEN o_orderkey % 10 = 0 THEN 'quantity is no number' END) AS why
FROM (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_custkey ELSE o_custkey END AS o_custkey FROM orders) LEFT JOIN customer ON o_custkey = c_custkey""")
def flagship(spark, d):
    """Orders: a lookup, a check, reasons for rejection, typed columns and defaults."""
    key = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN -1 - o_custkey ELSE o_custkey END AS o_custkey")  # some that aren't there
    df = table(spark, d, "orders").select("o_orderkey", key, "o_orderpriority", F.expr("CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE string(o_orderkey % 50) END AS quantity"))
    out = Pipeline.of(FLAGSHIP, tables={"customer": table(spark, d, "customer")}).over_table(df, marker=False)
    return frame.set_defaults(typing.columns_to_typed(out, ORDER).good, ORDER)
