"""Every registered query on empty tables and on tables of odd rows."""

import pytest

from sievework.llm.queries import QUERIES


def names():
    return [*sorted(QUERIES), "pipeline"]


def query(name):
    import corpus_pipeline

    return corpus_pipeline.run if name == "pipeline" else QUERIES[name]


VECTORS = [(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(120)] + [(50, [1.0, 2.0, 3.0]), (None, [1.0, 1.0, 1.0]), (121, None), (122, []), (150, [0.0, 0.0, 0.0]), (200, [None, 1.0, 1.0])]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory, crowded, empty, labels):
    """Tables with further columns by names that operators use, and the same without rows."""
    vectors = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<double>")
    out = {}
    for kind, docs, marks, points in (("odd", crowded, labels, vectors), ("empty", empty, labels.limit(0), vectors.limit(0))):
        d = tmp_path_factory.mktemp(kind)
        for name, df in (("documents", docs), ("labels", marks), ("embeddings", points)):
            df.write.parquet(f"{d}/{name}.parquet")
        out[kind] = str(d)
    return out


@pytest.mark.parametrize("name", names())
def test_no_rows_from_no_rows(spark, folders, name):
    assert query(name)(spark, folders["empty"]).collect() == []


@pytest.mark.parametrize("name", names())
def test_a_row_for_each_odd_row(spark, folders, rows, name):
    got = query(name)(spark, folders["odd"]).collect()
    if name == "op9_nearest_neighbours":
        assert {r.query_id for r in got} == {0, 50, 100} and all(r.score == r.score for r in got)
        assert sorted({r["rank"] for r in got if r.query_id == 0}) == [1, 2, 3, 4, 5]
    elif name == "pipeline":
        ids = {r.doc_id for r in got}
        toxic, copies = {i for i, t, *_ in rows if t and "idiot" in t}, {5, 8, 9}
        assert ids <= {r[0] for r in rows} and not ids & toxic and not ids & copies
    else:
        assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(r[0]) for r in rows)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_near_duplicates", "op10_repeats"])
def test_queries_against_sql(spark, name):
    from pathlib import Path

    import duckdb
    from conftest import sf

    from sievework.llm.queries import SQL

    d = sf("0.01" if name == "op1_mix_sources" else "0.001")
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    got = QUERIES[name](spark, d)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))
