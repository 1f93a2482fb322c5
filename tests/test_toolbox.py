import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sievework import more_queries, queries  # noqa: F401
from sievework.engine import AUTO_COPIED, Pipeline
from sievework.errors import ConfigError
from sievework.functions import schema as sch
from sievework.functions.convert import TrimConfig, convert, is_numeric, ltrim, rtrim
from sievework.functions.schema import Field, Schema
from sievework.operators import frame, typing
from sievework.sources import avro, sink
from sievework.streaming import over_stream


def converted(spark, kind, values, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    value, error = convert(F.col("v"), "f", kind, **more)
    return [(r.value, r.error) for r in df.select("i", value.alias("value"), error.alias("error")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        (S.IntegerType(), {"5": 5, " 12\t": 12, "+5": 5, "-7": -7, "010": 10}, ["1.5", "x", "2147483648", "1 2", "--1"]),
        (S.LongType(), {"9223372036854775807": 9223372036854775807, "-1": -1}, ["9223372036854775808", "1e3", "0x1"]),
        (S.DoubleType(), {"1.5": 1.5, "-1e3": -1000.0, " 2 ": 2.0, ".5": 0.5, "Infinity": float("inf")}, ["x", "1,5", "nan", "INFINITY"]),
        (S.BooleanType(), {"TRUE": True, " false ": False}, ["yes", "t", "1", "truex"]),
        (S.StringType(), {" x ": " x ", "": ""}, []),
    ],
)
def test_conversions(spark, kind, good, bad):
    got = converted(spark, kind, [*good, *bad])
    assert got[: len(good)] == [(v, None) for v in good.values()]
    assert got[len(good) :] == [(None, f"could not convert value '{v}' in field 'f' to a '{type(kind).__name__}'.") for v in bad]


def test_conversion_of_nothing_letters_and_untrimmed(spark):
    assert converted(spark, S.IntegerType(), [None, "", "  ", "\t"]) == [(None, None)] * 4
    assert converted(spark, S.IntegerType(), [None], nullable=False) == [(None, "attempt to store null value into a field that is non-nullable")]
    for kind in (S.IntegerType(), S.LongType(), S.DoubleType()):
        for v in ("1d", "1D", "1f", "1F", "1l", "1L"):
            assert converted(spark, kind, [v]) == [(None, f"can't convert '{v}' in field 'f' to {type(kind).__name__} type. (No alphanumeric characters are allowed in numeric fields.)")]
    untrimmed = TrimConfig(trim_numerics=False, trim_booleans=False)
    assert [v for v, _ in converted(spark, S.IntegerType(), [" 1", "1"], config=untrimmed)] == [None, 1]
    assert [v for v, _ in converted(spark, S.BooleanType(), [" true", "true"], config=untrimmed)] == [None, True]
    assert converted(spark, S.NullType(), [None, "x"])[1][1] is not None


def test_string_functions(spark):
    df = spark.createDataFrame([("\t a ",), (None,)], "v string")
    assert [tuple(r) for r in df.select(ltrim(F.col("v")), rtrim(F.col("v"))).collect()] == [("a ", "\t a"), (None, None)]
    values = ["0", "-12", "+3", "9" * 40, "12.5", "", " ", "x", None, "1-", "--1"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(is_numeric(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [True] * 4 + [False] * 7


FIELDS = '{"type":"record","name":"r","namespace":"n","fields":[{"name":"s","type":["string"],"default":"0"},{"name":"i","type":["null","int"],"default":null,"doc":"d"},{"name":"d","type":["double","null"],"default":5.0},{"name":"b","type":"boolean","default":false},{"name":"l","type":"long","default":3}]}'


def test_schema_parsing_and_writing():
    s = Schema.parse(FIELDS, for_output=True)
    assert [f.type.simpleString() for f in s.fields] == ["string", "int", "double", "boolean", "bigint"] and [f.nullable for f in s.fields] == [False, True, True, False, False]
    again = Schema.parse(s.to_json())
    assert again.fields == s.fields and s.struct_type()["d"].metadata == {"default": 5.0}
    assert [f.default for f in s.as_strings().fields] == ["0", None, "5.0", "false", "3"] and s.field("nope") is None
    assert s.field("l").default_as(int) == 3
    with pytest.raises(ConfigError):
        s.field("l").default_as(str)
    texts = json.loads(sch.stringify_schema_json(FIELDS))["fields"]
    assert [f["type"] for f in texts] == [["string"], ["null", "string"], ["string", "null"], "string", "string"] and texts[3]["default"] == "false"
    assert all(isinstance(f.dataType, S.StringType) and f.nullable for f in sch.all_string_struct(s.struct_type()))


@pytest.mark.parametrize(
    "field",
    [
        {"name": "a", "type": "int"},
        {"name": "a", "type": "double", "default": 0},
        {"name": "a", "type": "int", "default": 0.0},
        {"name": "a", "type": "string", "default": None},
        {"name": "a", "type": "boolean", "default": "true"},
        {"name": "a", "type": "int", "default": True},
        {"name": "a", "type": ["int", "string"], "default": 0},
        {"name": "a", "type": "bytes", "default": ""},
        {"name": "", "type": "int", "default": 0},
    ],
)
def test_bad_fields(field):
    with pytest.raises(ConfigError):
        Schema.parse(json.dumps({"type": "record", "name": "r", "fields": [field]}))


def test_output_schemas_take_no_float_and_no_null():
    for kind, default in (("float", 0.0), ("null", None)):
        text = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": kind, "default": default}]})
        Schema.parse(text)
        with pytest.raises(ConfigError):
            Schema.parse(text, for_output=True)


def test_frames(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "a int, b string, c double")
    plus, minus = frame.split(df, F.col("b") == "a")
    assert (plus.count(), minus.count()) == (1, 0)
    assert frame.data_type(df, "c") == S.DoubleType() and frame.data_type(df, "x") is None
    assert frame.empty_frame(spark, df.schema).schema == df.schema
    assert frame.add_column_with_default(df, Field("d", S.IntegerType(), True, None)).schema["d"].dataType == S.IntegerType()
    with pytest.raises(ConfigError):
        frame.add_column_with_default(df, Field("a", S.IntegerType(), False, 1))
    assert [c.dataType for c in frame.all_strings(df).schema] == [S.StringType()] * 3
    for bad in (["a", "b"], ["a", "b", "b"], ["a", "b", "x"]):
        with pytest.raises(ConfigError):
            frame.reorder_columns(df, bad)
        with pytest.raises(ConfigError):
            frame.safe_union(df, df.select("a", "b"))
    nested = df.select("a", F.struct("b", F.struct("c").alias("y")).alias("x"), F.array("a").alias("z"))
    assert frame.flatten(nested).columns == ["a", "b", "c", "z"]
    assert frame.drop_fields_starting_with(df.select("a"), "a").count() == 0 and frame.drop_fields_starting_with(df, "b").columns == ["a", "c"]
    for bad in ("", None):
        with pytest.raises(ConfigError):
            frame.drop_fields_starting_with(df, bad)
    assert frame.is_empty(df.limit(0)) and not frame.is_empty(df)
    assert frame.repartitioned(df, 7).rdd.getNumPartitions() == 7 and frame.repartitioned(df.repartition(5), 2).rdd.getNumPartitions() == 2
    maps = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('a', 0, 'c', 3) AS y").select(frame.merge_maps(F.col("x"), F.col("y")).alias("m"))
    assert maps.first().m == {"a": 1, "b": 2, "c": 3}
    assert sch.field_is_null(df.first(), "c") and sch.field_is_null(df.first(), "nope") and not sch.field_is_null(df.first(), "a")
    schema = Schema("s", (Field("b", S.StringType(), True, "z"), Field("c", S.DoubleType(), True, None), Field("n", S.BooleanType(), True, True)))
    assert [tuple(r) for r in frame.set_defaults(df, schema).collect()] == [(1, "a", None, True), (2, "z", 2.5, True)]
    good, errors = frame.change_schema(df, S.StructType([S.StructField("b", S.IntegerType()), S.StructField("a", S.StringType()), S.StructField("q", S.LongType())]))
    assert good.columns == ["a", "b", "q"] and [tuple(r) for r in good.collect()] == [("1", None, None), ("2", None, None)] and errors.count() == 0


def test_typed_records_defaults_and_errors(spark, tmp_path):
    rows = [{"id": "1", "i": "X1"}, {"id": "2", "b": "Xtrue", "d": "q"}, {"id": "3", "i": " ", "b": "TRUE"}, {"id": "4"}]
    enriched = spark.createDataFrame([(r,) for r in rows], "enriched map<string,string>")
    schema = Schema("s", (Field("id", S.StringType(), False, ""), Field("i", S.IntegerType(), True, 1), Field("b", S.BooleanType(), True, False), Field("d", S.DoubleType(), True, 5.0)))
    path = str(tmp_path / "out")
    for _ in range(2):  # the second run takes the first one's place
        errors = sink.write_enriched(enriched, schema, path)
    assert sorted(map(tuple, sink.read(spark, path).collect())) == [("3", 1, True, 5.0), ("4", 1, False, 5.0)]
    got = {r.enriched["id"]: r.enriched[typing.TYPE_ERROR] for r in errors.collect()}
    assert got["1"] == "could not convert value 'X1' in field 'i' to a 'IntegerType'."
    assert got["2"] == "could not convert value 'Xtrue' in field 'b' to a 'BooleanType'.; could not convert value 'q' in field 'd' to a 'DoubleType'."


def test_auto_copied_fields_stay_strings(spark):
    enriched = spark.createDataFrame([({"a": "1", "c": "3", AUTO_COPIED: "c"},), ({"a": "2"},)], "enriched map<string,string>")
    schema = Schema("s", (Field("a", S.IntegerType(), True, 0), Field("c", S.IntegerType(), True, 0), Field("z", S.IntegerType(), True, 0)))
    assert [f.dataType.simpleString() for f in typing.to_typed(enriched, schema).good.schema] == ["int", "string", "int"]
    assert typing.to_typed(enriched, schema, add_missing=False, type_auto_copied=True).good.dtypes == [("a", "int"), ("c", "int")]
    assert typing.to_string_columns(enriched).columns == sorted(["a", "c", AUTO_COPIED])


def test_avro_container(spark, tmp_path):
    df = spark.createDataFrame([(1, -(2**62), 1.5, 2.5, True, "é"), (None, 0, None, 0.0, False, "")], S.StructType([S.StructField("i", S.IntegerType()), S.StructField("l", S.LongType(), False), S.StructField("f", S.FloatType()), S.StructField("d", S.DoubleType()), S.StructField("b", S.BooleanType()), S.StructField("s", S.StringType())]))
    sink.write(df, str(tmp_path / "a"))
    back = sink.read(spark, str(tmp_path / "a"))
    assert back.schema.fieldNames() == df.columns and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert all(avro.unzigzag(__import__("io").BytesIO(avro.zigzag(n))) == n for n in (0, -1, 1, 63, 64, -65, 2**63 - 1, -(2**63)))


def test_avro_files_are_read_in_parts(spark, tmp_path, monkeypatch):
    """A file of many blocks, cut anywhere: every row once."""
    rows = [(i, f"text {i}" * (i % 7)) for i in range(5000)]
    schema = avro.schema_json(S.StructType([S.StructField("i", S.LongType()), S.StructField("s", S.StringType())]))
    monkeypatch.setattr(avro, "BLOCK_ROWS", 64)
    with open(tmp_path / "a.avro", "wb") as f:
        avro.write_container(f, iter(rows), schema)
    for split in (100, 1777, 1 << 20):
        monkeypatch.setattr(avro, "SPLIT", split)
        reader = avro._Reader(str(tmp_path))
        parts = reader.partitions()
        assert [r for part in parts for r in reader.read(part)] == rows and (len(parts) > 1 or split == 1 << 20)


def test_an_overwrite_leaves_the_new_rows_only(spark, tmp_path):
    for n in (5, 3):
        sink.write(spark.range(n), str(tmp_path / "a"))
    assert sink.read(spark, str(tmp_path / "a")).count() == 3


def test_streams_give_what_batches_give(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"a": "1", "b": null}\n{"a": "2"}\n')
    pipeline = Pipeline.of({"items": [{"actions": [{"actionType": "simple-copy", "config": {"inputSource": ["a"]}}]}]})
    out = over_stream(pipeline, spark.readStream.text(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = pipeline.over_json(spark.read.text(str(tmp_path / "in")))
    assert sorted(map(repr, spark.table("streamed").collect())) == sorted(map(repr, batch.collect()))


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(queries.SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_files(tmp_path):
    from sievework.sources import files

    path = files.write_file('{"a":\n 1}\n', str(tmp_path / "c.json"))
    assert files.file_to_string(path) == '{"a": 1}'
    temp = files.write_temp_file("x")
    assert Path(temp).read_text() == "x"
    Path(temp).unlink()
