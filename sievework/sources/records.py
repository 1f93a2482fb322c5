"""Input records: JSON lines, strings, or the rows of a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..plans.state import Records, State

#: What becomes of a line that isn't a JSON object.
FAIL, ERROR = "fail", "error"


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or a folder, blank ones left out."""
    return spark.read.text(path).filter(F.trim("value") != "")


def json_strings(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], "value string")


def json_state(df: DataFrame, malformed: str = FAIL, kinds: bool = False) -> State:
    """Records from a column value of JSON objects: a map of strings, null for JSON null, structures as compact JSON.

    kinds also finds which fields hold JSON text, at the price of a second parse.
    Other columns of df are left out.
    """
    raw = F.col("__line")
    named = [F.from_json(raw, "map<string,string>").alias("input")]
    if kinds:
        typed = F.from_json(raw, "map<string,variant>")
        named.append(F.map_keys(F.map_filter(typed, lambda _, v: F.schema_of_variant(v) == "STRING")).alias("strings"))
    # An explode of one element, so that no use of a field parses the line again.
    df = df.select(F.col("value").alias("__line")).select("__line", F.explode(F.array(F.struct(*named))).alias("__record"))
    message = F.concat(F.lit("not a JSON object: "), F.substring(raw, 1, 200))
    parsed = F.col("__record.input")
    bad = parsed.isNull() & raw.isNotNull()
    record = F.coalesce(parsed, F.create_map().cast("map<string,string>"))
    if malformed == FAIL:
        record = F.when(bad, F.raise_error(message)).otherwise(record)
    df = df.select("__line", record.alias("__input"), bad.alias("__bad"), *([F.col("__record.strings").alias("__strings")] if kinds else []))
    state = State(df, Records())
    return state if malformed == FAIL else state.fail(F.col("__bad"), message)


def table_state(df: DataFrame) -> State:
    """Records from columns: every field is there, SQL null is null, and only string columns hold text."""
    inner = {c: f"__in_{i}" for i, c in enumerate(df.columns)}

    def text(f: S.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(c) if isinstance(f.dataType, (S.StructType, S.ArrayType, S.MapType)) else c.cast("string")

    whole = {f.name: f"__raw_{i}" for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, (S.IntegerType, S.LongType))}
    renamed = df.select(*[text(f).alias(inner[f.name]) for f in df.schema.fields], *[F.col(f"`{c}`").alias(n) for c, n in whole.items()])
    strings = {f.name: isinstance(f.dataType, S.StringType) for f in df.schema.fields}
    return State(renamed, Records({c: F.col(n) for c, n in inner.items()}, strings, {c: F.col(n) for c, n in whole.items()}))
