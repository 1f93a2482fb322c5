"""Joins to a table with one row for each key, where one key may have a third of all rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1 / HOT of all rows is a hot one; there are fewer than HOT.
HOT = 1024


def answered(rows: DataFrame, answers: DataFrame, keys: Mapping[str, str], copies: str = "copies", how: str = "left", nulls: bool = False) -> DataFrame:
    """rows joined to answers, which has one row for each key and, in copies, the number of rows that have it.

    keys maps columns of rows to those of answers; these and copies are not in
    the result. Rows of a hot key are dealt to as many parts as it takes for no
    part to have more than 1 / HOT of all rows, and its answer is repeated for
    each: fewer than 2 * HOT rows more, whatever the data. Rows that have a null
    in a key find nothing, and are dealt to HOT parts; with nulls, null is a key
    like any other. The keys of hot ones, fewer than HOT
    rows, are broadcast. answers is read three times, so it should be stored.
    """
    total = answers.agg(F.sum(copies)).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col(copies) * HOT / F.lit(max(1, total)))).cast("int")
    hot = answers.select(*[F.col(v).alias(f"__hot_{v}") for v in keys.values()], parts.alias("__parts")).filter("__parts > 1")
    same = (lambda x, y: x.eqNullSafe(y)) if nulls else (lambda x, y: x == y)
    meet = [same(F.col(k), F.col(f"__hot_{v}")) for k, v in keys.items()]
    lost = F.lit(False) if nulls else F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    dealt = F.when(lost, F.lit(HOT)).otherwise(F.coalesce("__parts", F.lit(1)))
    spread = rows.join(F.broadcast(hot), meet, "left").select(*rows.columns, F.pmod(F.monotonically_increasing_id(), dealt).cast("int").alias("__salt"))
    added = [c for c in answers.columns if c not in (copies, *keys.values())]
    named = [F.col(v).alias(f"__key_{v}") for v in keys.values()]
    table = answers.select(*named, *added, F.explode(F.sequence(F.lit(0), parts - 1)).alias("__part"))
    on = [same(F.col(k), F.col(f"__key_{v}")) for k, v in keys.items()] + [F.col("__salt") == F.col("__part")]
    return spread.join(table, on, how).select(*rows.columns, *added)
