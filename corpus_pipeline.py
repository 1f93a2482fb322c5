"""The corpus pipeline: stages over documents, each written as Parquet and read again for the next.

Toxic documents go, one document of each group of near copies stays, personal
data is replaced by its kind, sources are mixed to their target weights (a
document that the mix repeats is as many rows), and texts become ids.

Odd rows, the same for all stages: a null or empty text is not toxic, has no near
copy and no personal data, but no words either, so the mix takes none of it; a
null lang, source or n_chars passes; null is a source like any other; rows with a
null doc_id are kept or dropped by their texts; a row that repeats another wholly
is a copy of it, and one row stays. An empty table, or one without labels, gives
an empty one, or what the models make of texts without labels. Further columns of
the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm._store import stored
from sievework.llm.mixing import mix, repeated
from sievework.llm.near_dedup import deduplicated
from sievework.llm.pii import redacted
from sievework.llm.subword import encoded, load
from sievework.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labels that aren't held out; a null text scores as an empty one."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter(f"tox_score < {THRESHOLD}").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, 80 % alike in shingles of five words: that with the smallest doc_id.

    A text without words has no copy and stays; of rows that repeat the kept doc_id and set one stays.
    """
    return deduplicated(docs, 80).select(*COLUMNS)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; n_chars stays that of the original, a null text null."""
    return redacted(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at 5, 2, 1 by name, 150 % of the words that are left, 2 epochs at most; a repetition is a row.

    Ties in a source's order are rows that agree in doc_id and text: they are taken together. A text without words is not taken.
    """
    return repeated(mix(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids in the place of texts; an empty or null text has none."""
    return encoded(docs, load())


STAGES = [("toxicity", not_toxic), ("minhash", one_of_each), ("pii", without_pii), ("mixing", mixed), ("sentencepiece", tokens)]

#: Learned scores and seeded samples are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, with a table in the shared folder between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
