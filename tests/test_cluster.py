"""What only shows where executors are other processes than the driver."""

import datetime
import decimal
import json
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sievework.sources import derby

ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"

RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry

folder, name, d = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,2,1024]", "spark.executor.memory": "600m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"file://{folder}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
try:
    rows = [list(r) for r in entry.queries()[name](spark, d).collect()]
finally:
    spark.stop()
open(f"{folder}/rows", "w").write(json.dumps(rows))
"""


@pytest.mark.parametrize("name", ["jdbc_lookup", "jdbc_lookup_any_where"])
def test_executors_reach_the_database(name, tmp_path):
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), name, DATA], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    with duckdb.connect() as sql:
        for table in ("supplier", "nation"):
            sql.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        want = sql.execute(entry.oracle_sql()[name]).fetchall()
    assert sorted(map(repr, json.loads((tmp_path / "rows").read_text()))) == sorted(repr(list(r)) for r in want)


def test_a_packed_database_gives_its_rows_back(spark, tmp_path):
    schema = "k int, b bigint, d double, s string, n decimal(9,2), t date, ok boolean"
    rows = [(1, 2**40, 0.5, "a'b\nç", decimal.Decimal("1.25"), datetime.date(2020, 2, 29), True), (2, -1, -0.25, "", None, None, False), (None,) * 7]
    rows += [(k, k, float(k), str(k), decimal.Decimal(f"{k}.00"), None, None) for k in range(3, 2 * derby.BATCH + 5)]
    path = f"{tmp_path}/new/x.jar"
    url = derby.packed(spark.createDataFrame(rows, schema), "kept", path)
    assert {i.compress_type for i in zipfile.ZipFile(path).infolist()} == {zipfile.ZIP_STORED}
    got = spark.read.jdbc(url, "kept", column="k", lowerBound=0, upperBound=2000, numPartitions=3)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
    assert spark.read.jdbc(derby.packed(spark.createDataFrame([], schema), "kept", f"{tmp_path}/none.jar"), "kept").count() == 0


def test_a_database_in_another_store_is_refused(spark):
    with pytest.raises(ValueError, match="file system"):
        derby.local_path(spark, "viewfs://store/x.jar")
