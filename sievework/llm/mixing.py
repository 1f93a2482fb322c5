"""Mixing sources to target weights, in DataFrame operations only.

Every source gets a share of a budget in words, in proportion to its weight,
but never more than a number of epochs of what it has. What a clamped source
leaves over goes to the others by weight (water-filling). A source's epochs
are then whole repetitions of all its documents, and a seeded sample of whole
documents for the fractional rest.

How the plan grows: the texts are read, counted and hashed where they are, and
not shuffled as long as the table of sources is small enough to be broadcast. Shuffled are sums for each source and for each bucket of about
BUCKET documents; both combine before the shuffle, so a source with a third of
all rows is no hot key. Only the one bucket of each source in which its sample
ends is gathered. The table with a row for each source is put in order in one
task (a million sources are some 50 MB) and joined back; whether it is broadcast
is left to its measured size, and where it isn't, large sources are dealt out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._join import answered
from ._store import stored

#: A word, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a bucket of the sample's order, on average.
BUCKET = 256
#: Columns that mix() adds; a column of the input by such a name is replaced.
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def word_count(text: Column) -> Column:
    """Words in a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(weights: Sequence[float] | Mapping[str | None, float]) -> Column:
    if isinstance(weights, Mapping):
        out = F.lit(0.0)
        for name, value in weights.items():
            out = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(out)
        return out
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))


def targets(stats: DataFrame, weights: Sequence[float] | Mapping[str | None, float], budget_ratio: float, max_epochs: float) -> DataFrame:
    """Water-filling over a table with a row for each source: __source, __total, __n.

    With sources in order of cap / weight, the water level is the largest of
    (budget - caps before) / (weights from here on): it rises as long as
    sources are clamped and falls after that.
    """
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("__source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    active = F.col("__w") > 0
    s = stats.withColumn("__w", _weight(weights)).withColumn("__cap", F.when(active, F.col("__total") * F.lit(float(max_epochs))).otherwise(0.0))
    s = s.withColumn("__w", F.when(active, F.col("__w")))
    s = s.withColumn("__budget", F.sum("__total").over(everything) * F.lit(float(budget_ratio)))
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward)
    s = s.withColumn("__level", level).withColumn("__level", F.max(F.when(F.col("__w").isNotNull(), F.col("__level"))).over(everything))
    s = s.withColumn("__target", F.coalesce(F.least(F.col("__cap"), F.col("__level") * F.col("__w")), F.lit(0.0)))
    whole = F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total") + 1e-9)).otherwise(0).cast("long")
    s = s.withColumn("__whole", whole)
    s = s.withColumn("__rest", F.greatest(F.lit(0), F.round(F.col("__target") - F.col("__whole") * F.col("__total"))).cast("long"))
    return s.withColumn("__buckets", F.ceil(F.col("__n") / F.lit(float(BUCKET))).cast("long")).select("__source", "__total", "__n", "__target", "__whole", "__rest", "__buckets")


def _bucket() -> Column:
    unit = F.shiftright(F.col("__h"), 8).cast("double") / F.lit(float(1 << 52))
    return F.floor(unit * F.col("__buckets")).cast("long")


def _plan(sized: DataFrame, weights, budget_ratio: float, max_epochs: float) -> DataFrame:
    """For each source its target, whole repetitions, and which documents the fractional repetition takes."""
    stats = sized.groupBy("__source").agg(F.sum("__size").alias("__total"), F.count(F.lit(1)).alias("__n"))
    goals = stored(targets(stats, weights, budget_ratio, max_epochs), "mix-targets")
    named = goals.select(F.col("__source").alias("__s"), "__buckets", "__rest", "__n")
    dealt = answered(sized, named, {"__source": "__s"}, "__n", "inner", True).select("__source", "__h", "__size", "__rest", _bucket().alias("__b"))
    sums = dealt.groupBy("__source", "__b").agg(F.sum("__size").alias("__words"), F.first("__rest").alias("__rest"))
    run = Window.partitionBy("__source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__words").over(run), F.lit(0)))
    ends = sums.filter((F.col("__rest") > 0) & (F.col("__before") <= F.col("__rest")) & (F.col("__rest") < F.col("__before") + F.col("__words")))
    ends = stored(ends.select(F.col("__source").alias("__s"), F.col("__b").alias("__end"), (F.col("__rest") - F.col("__before")).alias("__room")), "mix-ends")
    last = dealt.join(ends, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__end")))
    last = last.groupBy("__source", "__end", "__room", "__h").agg(F.sum("__size").alias("__size"))
    listed = last.groupBy("__source", "__end", "__room").agg(F.array_sort(F.collect_list(F.struct("__h", "__size"))).alias("__list"))
    fits = F.aggregate(
        "__list",
        F.struct(F.col("__room").alias("room"), F.array().cast("array<bigint>").alias("picks")),
        lambda a, x: F.when(x["__size"] <= a["room"], F.struct((a["room"] - x["__size"]).alias("room"), F.concat(a["picks"], F.array(x["__h"])).alias("picks"))).otherwise(a),
    )["picks"]
    picks = listed.select(F.col("__source").alias("__p"), "__end", fits.alias("__picks"))
    plan = goals.join(picks, F.col("__source").eqNullSafe(F.col("__p")), "left").withColumnRenamed("__source", "__s").drop("__p", "__rest")
    return stored(plan, "mix-plan")


def _taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    extra = F.when(F.col("__end").isNull(), F.col("__target") > F.col("__whole") * F.col("__total") + 0.5).otherwise((_bucket() < F.col("__end")) | F.coalesce(F.array_contains("__picks", F.col("__h")), F.lit(False)))
    copies = F.col("__whole") + F.coalesce(extra, F.lit(False)).cast("long")
    out = answered(sized, plan, {"__source": "__s"}, "__n", nulls=True)
    return out.withColumns({"mix_size": F.col("__size"), "mix_source_size": F.col("__total"), "mix_target": F.col("__target"), "mix_copies": copies, "mix_taken": copies * F.col("__size")})


def sized(docs: DataFrame, seed: int, text: str, source: str, doc_id: str) -> DataFrame:
    """docs with source, size and a seeded hash that orders a source's documents: 60 bits of an MD5, which other engines have too."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    h = F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")
    return docs.withColumns({"__source": F.col(source), "__size": word_count(F.col(text)), "__h": h})


def mix(docs: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = (5, 2, 1), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """docs with the columns ADDED: how often the mix takes each row, and the words that makes.

    weights: by source name, a name that is missing weighing nothing, or a
    cycle over the sources in the order of code points with null last. The
    budget is budget_ratio times all words. A source's taken words differ from
    its target by less than the shortest document that its last bucket has
    left over, unless rows repeat.

    Defined cases: a null text has size 0 and so does an empty one; null is a
    source like any other; a source without words has target 0, and its rows
    get 0 copies; rows that agree in doc_id and text are taken together; an
    empty table gives an empty one; columns named like those in ADDED are
    replaced, others pass through.
    """
    docs = docs.drop(*ADDED)
    rows = sized(docs, seed, text, source, doc_id)
    plan = _plan(stored(rows.select("__source", "__size", "__h"), "mix-sizes"), weights, budget_ratio, max_epochs)
    return _taken(rows, plan).select(*docs.columns, *ADDED)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as mix() takes it, without the columns ADDED."""
    rows = mixed.filter("mix_copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))))
    return rows.drop("__copy", *ADDED)


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; targets are 5, 2, 1 by source, 150 % of all words, 2 epochs at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = stored(sized(docs, 7, "text", "source", "doc_id").drop("text", "source"), "mix-sizes")
    out = _taken(rows, _plan(rows, (5, 2, 1), 1.5, 2.0))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))
