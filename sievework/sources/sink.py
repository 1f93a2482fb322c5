"""Writing: typed rows to a folder that is overwritten, and error records back to the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S

from ..functions.convert import TrimConfig
from ..functions.schema import Schema, load_schema
from ..operators.frame import Outcome, change_schema, repartitioned, set_defaults
from ..operators.typing import to_typed
from . import avro


@dataclass(frozen=True)
class WriterConfig:
    """partitions 0 leaves their number to adaptive execution; format "avro" uses Spark's own source where there is one."""

    trim: TrimConfig = field(default_factory=TrimConfig)
    partitions: int = 0
    format: str = "avro"
    persist: StorageLevel | None = None
    add_missing: bool = True
    type_auto_copied: bool = False


def _format(spark: SparkSession, name: str) -> str:
    if name != "avro":
        return name
    try:
        spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource("avro", spark._jsparkSession.sessionState().conf())
        return "avro"
    except Exception:  # noqa: BLE001  the module is not on the class path
        spark.dataSource.register(avro.AvroSource)
        return avro.FORMAT


def write(df: DataFrame, path: str, config: WriterConfig | None = None) -> None:
    """Rows of df in the place of whatever is at path."""
    config = config or WriterConfig()
    df = repartitioned(df, config.partitions)
    df.write.format(_format(df.sparkSession, config.format)).mode("overwrite").save(path)


def read(spark: SparkSession, path: str, format: str = "avro") -> DataFrame:
    return spark.read.format(_format(spark, format)).load(path)


def write_conforming(df: DataFrame, schema: S.StructType, path: str, config: WriterConfig | None = None, strict: bool = False) -> DataFrame:
    """Write df as change_schema() makes it, and return its error rows."""
    good, errors = change_schema(df, schema, strict)
    write(good, path, config)
    return errors


def write_enriched(enriched: DataFrame, schema: Schema | str, path: str, config: WriterConfig | None = None) -> DataFrame:
    """Type, default and write records of a column enriched; return those that can't be typed.

    schema is one or the path of its file. With persist, the typed rows are kept
    while they are written; the records aren't read twice unless the errors are.
    """
    config = config or WriterConfig()
    schema = load_schema(enriched.sparkSession, schema) if isinstance(schema, str) else schema
    schema.check_output()
    done: Outcome = to_typed(enriched, schema, config.trim, config.add_missing, config.type_auto_copied)
    rows = set_defaults(done.good, schema)
    if config.persist:
        rows = rows.persist(config.persist)
    try:
        write(rows, path, config)
    finally:
        if config.persist:
            rows.unpersist()
    return done.errors
