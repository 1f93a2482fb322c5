"""Cross-entropy difference between two n-gram models.

A target model is counted over the documents that count as the target, a
background model over all. They are matched: one vocabulary (all words of all
documents), one order (pairs of words), one smoothing. A document's score is
its tokens' mean loss in the target model less that in the background model, in
bits: below 0 it looks more like the target.

P(b | a) = (c(a, b) + MASS P(b)) / (c(a) + MASS), with exact counts of all words
and all pairs: there is no cap on either. Words and pairs are told apart by
64-bit hashes; among n different ones some two share a hash with a probability
below n^2 / 2^65 (for 10^9 pairs 0.03).

How the plan grows: texts are taken in blocks of BLOCK bytes, and stored as
places in the block's list of words. A block sends its different words and
pairs, sorted and packed, with their counts to parts, which are ranges of the
hash; their number grows with the bytes of text. A part adds up what all blocks
sent, and answers each block with the sums of what it asked, which meet it.
So each key has one entry for each block, however common it is; the tables grow
with the corpus, and only three sums reach the driver. There are as many rows as
blocks times parts, some millions at 30 GB, until at some terabytes a block has
one key in each; from there on they are as many as keys, which costs more bytes
for each and still grows as the corpus does. BLOCK may be raised by then.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._store import release, stored, sweep
from .quality import fit_quality, scored_batches

MASS = 8.0
#: Bytes of text in a block, and for each part.
BLOCK, PART = 1 << 23, 1 << 23
#: What stands before a text's first word.
START = np.uint64(1)
_ADDED = ("n_tokens", "target_loss", "background_loss", "lm_score")


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in lower case, and how many words come before each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, part, at in T.blocks(data, offsets):
        part = T.lower(part)
        start, end, first = T.words(part, at)
        hashes.append(T.span_hash(part, start, end))
        counts.append(np.diff(first))
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def pack(x: np.ndarray) -> bytes:
    """x with the bytes of each place of its numbers side by side, compressed: sorted or small numbers get short."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(packed[8:], n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def pair_keys(words: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the word before each word (that of START before a text's first), and the hash of the two."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1][np.diff(first) > 0]] = np.searchsorted(words, START)
    return before, T.mix(T.mix(words)[before] * np.uint64(3) + words[ids])


def pack_sorted(x: np.ndarray) -> bytes:
    """pack() of the steps between sorted numbers."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint64), dtype=np.uint64)


def pack_ids(ids: np.ndarray, words: int) -> dict[str, bytes]:
    """ids as ranks by how often each of the words occurs, frequent ones first, which are short; and how often that is."""
    often = np.bincount(ids, minlength=words)
    rank = np.empty(words, np.uint32)
    rank[np.argsort(-often, kind="stable")] = np.arange(words, dtype=np.uint32)
    return {"ids": pack(rank[ids]), "often": pack(often.astype(np.uint32))}


def unpack_ids(row: dict) -> np.ndarray:
    return np.argsort(-unpack(row["often"], np.uint32).astype(np.int64), kind="stable").astype(np.uint32)[unpack(row["ids"], np.uint32)]


_COUNTS = ("pair_n", "pair_t", "word_n", "word_t", "first_n", "first_t")
_BLOCK = "block bigint, counted boolean, asked boolean, rows binary, words binary, first binary, marks binary, ids binary, often binary"
_SENT = "block bigint, part int, pairs binary, words binary, " + ", ".join(f"{c} binary" for c in _COUNTS)


def _blocks(counted: bool, asked: bool, keep: list[str]):
    """A row for each block: its words, its texts as places among them, and if it asks, the documents' other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            marks = batch.column("__target").to_numpy(zero_copy_only=False).astype(np.uint8)
            for i, j, piece, at in T.blocks(data, offsets, BLOCK):
                h, first = word_hashes(piece, at)
                words, ids = np.unique(np.append(h, START), return_inverse=True)
                sink = pa.BufferOutputStream()
                kept = batch.slice(i, j - i).select(keep)
                with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(kept)
                packed = {"rows": sink.getvalue().to_pybytes(), "words": pack_sorted(words), "first": pack(first), "marks": pack(marks[i:j])} | pack_ids(ids[:-1], len(words))
                row = {"block": int.from_bytes(os.urandom(8), "little") >> 1, "counted": counted, "asked": asked} | packed
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary() if isinstance(v, bytes) else None) for k, v in row.items()})

    return run


def _requests(parts: int):
    """For each block a row for each part: different pairs and words with their counts; block is -1 if it doesn't ask."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((n, pa.binary()) for n in ("pairs", "words", *_COUNTS))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(len(batch))):
            words, ids, first = unpack_sorted(row["words"]), unpack_ids(row), unpack(row["first"], np.int64)
            target = np.repeat(unpack(row["marks"], np.uint8).astype(bool), np.diff(first))
            before, key = pair_keys(words, ids, first)
            pairs, which = np.unique(key, return_inverse=True)
            counts = {}
            for name, index, size in (("pair", which, len(pairs)), ("word", ids, len(words)), ("first", before, len(words))):
                counts[name + "_n"] = np.bincount(index, minlength=size).astype(np.uint32) * np.uint32(row["counted"])
                counts[name + "_t"] = np.bincount(index[target], minlength=size).astype(np.uint32) * np.uint32(row["counted"])
            cuts = [np.append(0, np.searchsorted(part_of(x, parts), np.arange(1, parts + 1))) for x in (pairs, words)]
            out = []
            for p in range(parts):
                a, b = (slice(c[p], c[p + 1]) for c in cuts)
                if a.start < a.stop or b.start < b.stop:
                    out.append({"block": row["block"] if row["asked"] else -1, "part": p, "pairs": pack_sorted(pairs[a]), "words": pack_sorted(words[b])} | {n: pack(x[a if n.startswith("pair") else b]) for n, x in counts.items()})
            for s in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[s : s + 64], schema=schema)

    return run


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: ranges of equal width, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


_ANSWER = "answer_to bigint, at int, " + ", ".join(f"{c} binary" for c in _COUNTS) + ", different bigint, tokens_n bigint, tokens_t bigint"


def _answers(table: pa.Table) -> pa.Table:
    """A part's sums, for each block what it asked for; and a row with the part's different words and tokens."""
    blocks, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
    found, cuts, own = {}, {}, None
    for name, sums in (("pairs", _COUNTS[:2]), ("words", _COUNTS[2:])):
        keys = [unpack_sorted(x.as_py()) for x in table.column(name)]
        cuts[name] = np.append(0, np.cumsum([len(k) for k in keys]))
        one, which = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        for c in sums:
            n = np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column(c)])
            total = np.bincount(which, n, len(one)).astype(np.int64)  # exact below 2^53
            found[c] = (total, which)
        if name == "words":
            own = {"at": part, "different": int((found["word_n"][0] > 0).sum()), "tokens_n": int(found["word_n"][0].sum()), "tokens_t": int(found["word_t"][0].sum())}
    # START is no word: its word_n is 0, its first_n isn't. It is in the list of each block for its place alone.
    out = [own]
    for i, block in enumerate(blocks):
        if block >= 0:
            got = {"answer_to": block, "at": part}
            for c, (total, which) in found.items():
                cut = cuts["pairs" if c in _COUNTS[:2] else "words"]
                got[c] = pack(total[which[cut[i] : cut[i + 1]]])
            out.append(got)
    schema = pa.schema([("answer_to", pa.int64()), ("at", pa.int32()), *((c, pa.binary()) for c in _COUNTS), *((c, pa.int64()) for c in ("different", "tokens_n", "tokens_t"))])
    return pa.Table.from_pylist(out, schema=schema)


def _parts(*texts: DataFrame) -> int:
    size = sum(x.select(F.octet_length("text").alias("n")).agg(F.sum("n")).first()[0] or 0 for x in texts)
    return max(1, -(-size // PART))


def _summed(blocks: DataFrame, parts: int) -> DataFrame:
    asks = blocks.select("block", "counted", "asked", "words", "first", "marks", "ids", "often").mapInArrow(_requests(parts), _SENT)
    return stored(asks.repartition(_tasks(parts), "part").groupBy("part").applyInArrow(_answers, _ANSWER), "lm-answers")


def _tasks(parts: int) -> int:
    """Tasks for so many parts, or blocks, which are about as many: what one reads does not grow."""
    return min(parts, 1 << 15)


def _totals(answers: DataFrame) -> tuple[int, int, int]:
    """Different words, tokens of all documents, tokens of the target."""
    return tuple(x or 0 for x in answers.filter("answer_to is null").agg(F.sum("different"), F.sum("tokens_n"), F.sum("tokens_t")).first())


def _ready(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__target", F.coalesce(F.col("target").cast("int"), F.lit(0)) != 0)


@dataclass
class Vocabulary:
    """All words of a corpus: rows with text and target."""

    corpus: DataFrame
    _words: range | None = field(default=None, repr=False)

    @property
    def words(self) -> range:
        """A place for each different word; they are counted when first asked for."""
        if self._words is None:
            rows = _ready(self.corpus).select("text", "__target")
            blocks = stored(rows.mapInArrow(_blocks(True, False, []), _BLOCK), "lm-blocks")
            answers = _summed(blocks, _parts(rows))
            self._words = range(_totals(answers)[0])
            release(blocks, answers)
        return self._words


@dataclass
class Model:
    """Names the counts of all documents ("n") or of the target ("t")."""

    counts: str


def _losses(words: int, tokens: dict[str, int]):
    """Documents of a block with the sums that its parts answered."""

    def loss(got: dict[str, np.ndarray], k: str, pair: np.ndarray, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        single = (got["word_" + k][ids] + 0.5) / (tokens[k] + 0.5 * (words + 2))
        return -np.log2((got["pair_" + k][pair] + MASS * single) / (got["first_" + k][before] + MASS))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("at")
        got = {c: np.concatenate([np.zeros(0, np.int64), *(unpack(x.as_py(), np.int64) for x in answers.column(c))]) for c in _COUNTS}
        row = docs.to_pylist()[0]
        known, ids, first = unpack_sorted(row["words"]), unpack_ids(row), unpack(row["first"], np.int64)
        before, key = pair_keys(known, ids, first)
        pair = np.unique(key, return_inverse=True)[1]
        n = np.diff(first)
        text = np.repeat(np.arange(len(n)), n)
        empty = n == 0
        a, b = (np.bincount(text, loss(got, k, pair, before, ids), len(n)) / np.maximum(n, 1) for k in ("t", "n"))
        kept = pa.ipc.open_stream(row["rows"]).read_next_batch()
        added = {"n_tokens": pa.array(n.astype(np.int64)), "target_loss": pa.array(a, mask=empty), "background_loss": pa.array(b, mask=empty), "lm_score": pa.array(a - b, mask=empty)}
        return pa.Table.from_arrays([*kept.columns, *added.values()], names=[*kept.schema.names, *added])

    return run


def _scored(blocks: DataFrame, parts: int, fields: list) -> DataFrame:
    answers = _summed(blocks, parts)
    words, n, t = _totals(answers)
    sweep(blocks.sparkSession)
    docs = blocks.filter("asked").select("block", "rows", "words", "first", "ids", "often").repartition(_tasks(parts), "block").groupBy("block")
    asked = answers.filter("answer_to is not null").select("answer_to", "at", *_COUNTS).repartition(_tasks(parts), "answer_to").groupBy("answer_to")
    return docs.cogroup(asked).applyInArrow(_losses(words, {"n": n, "t": t}), T.schema_of(fields, "n_tokens bigint", "target_loss double", "background_loss double", "lm_score double"))


def marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with target, 1 for the documents whose doc_id is in marks; null is no mark. Joins, so it shuffles the texts."""
    marks = marks.select(F.col("doc_id").alias("__id")).filter("__id is not null").distinct().withColumn("__marked", F.lit(1))
    rows = docs.drop("target").join(marks, F.col("doc_id") == F.col("__id"), "left")
    return rows.withColumn("target", F.coalesce("__marked", F.lit(0))).drop("__id", "__marked")


def fit_models(rows: DataFrame) -> tuple[Vocabulary, Model, Model]:
    """Vocabulary, target model and background model of rows with text and target (1 or 0; null is 0).

    They are counted with the documents that are scored. Without any row of the
    target, its model is the smoothing alone.
    """
    return Vocabulary(rows.select("text", "target")), Model("t"), Model("n")


def score_lm(docs: DataFrame, vocabulary: Vocabulary, target: Model, background: Model) -> DataFrame:
    """docs with n_tokens, target_loss and background_loss (bits a token) and lm_score, their difference.

    Defined cases: a text without words, null too, has 0 tokens and null losses
    and score; equal texts get equal scores; columns of docs by these names are
    replaced, others pass through.
    """
    docs = docs.drop(*_ADDED)
    corpus = _ready(vocabulary.corpus).select("text", "__target")
    counts = corpus.mapInArrow(_blocks(True, False, []), _BLOCK)
    asks = docs.withColumn("__target", F.lit(False)).mapInArrow(_blocks(False, True, docs.columns), _BLOCK)
    return _scored(stored(counts.union(asks), "lm-blocks"), _parts(corpus, docs), docs.schema.fields)


def score_corpus(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """rows (text, target, others) without these two, scored as by score_lm() with models fitted on rows; sized has the texts, at no cost to read."""
    docs = rows.drop("text", "target", *_ADDED)
    keep = _ready(rows).select("text", "__target", *docs.columns)
    return _scored(stored(keep.mapInArrow(_blocks(True, True, docs.columns), _BLOCK), "lm-blocks"), _parts(sized), docs.schema.fields)


def score_by_quality(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """docs without text, scored as by score_corpus(); the target is what a quality model scores least or more.

    The model is asked where a text is cut into its block, in the same pass.
    """
    docs = docs.drop(*_ADDED, "quality_score")
    rest = docs.drop("text")
    kept = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = scored_batches(model)(T.small(batches, 4096))
        marks = (T.with_columns(b, {"__target": pa.array(b.column("quality_score").to_numpy() >= least)}) for b in judged)
        return _blocks(True, True, kept)(marks)

    return _scored(stored(docs.mapInArrow(run, _BLOCK), "lm-blocks"), _parts(docs), rest.schema.fields)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference; the target is what the quality model, learned from labels, holds good.

    That is decided at each text, so documents are not joined to anything.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_by_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
