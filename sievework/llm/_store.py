"""Tables between the steps of a job, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and no other machine takes part, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session is gone, and the folder with it or later by hand
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sievework-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    The result has no lineage beyond its files, so a lost executor costs no
    earlier step, and Spark knows its size when it chooses a join.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete tables made by stored() that no later step reads, and let Spark delete the shuffle files of steps that are over."""
    for table in tables:
        _remove(table.sparkSession, table.stored_at)
    sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over, as it does when their plans are collected as garbage."""
    gc.collect()
    # Spark holds on to the last query, and what Python has dropped is let go in the JVM by a thread of its own, a little later.
    spark.range(1).count()
    time.sleep(0.2)
    spark.sparkContext._jvm.System.gc()
