"""Labelled rows for fitting, without those that are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether a row is held out; a null doc_id is not."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, each: int) -> DataFrame:
    """(text, label) of at most each labelled documents of either label, never a held-out one.

    Taken are the first by a hash of doc_id, so the choice does not depend on
    how rows are dealt out. Rows of labels without doc_id or label are left
    out; a doc_id labelled both ways counts as 1. Only ids and labels of the
    2 * each rows, a fixed number, are broadcast.
    """
    y = F.col(label).cast("int")
    known = labels.filter(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out(F.col("doc_id"), modulus, rest)).groupBy("doc_id").agg(F.max(y).alias("__y"))
    mark = F.xxhash64("doc_id")
    sample = known.filter("__y = 1").orderBy(mark, "doc_id").limit(each).union(known.filter("__y = 0").orderBy(mark, "doc_id").limit(each))
    sample = sample.withColumnRenamed("doc_id", "__id")
    return docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("text", F.col("__y").alias("label"))
