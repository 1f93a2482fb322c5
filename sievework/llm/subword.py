"""SentencePiece encoding and decoding over a lattice of pieces, relation by relation.

For a block of texts: words are the runs that no piece can cross; the distinct
ones are exploded into their substrings of bounded length; these are joined by
hash to the piece table and held against the piece's characters, which gives the
lattice's edges (start, length, piece); words count as equal by characters too;
the edges of a word, as a table by start and length, are folded into its pieces;
and the words' pieces are joined back to the texts. All words of a block go
through each step at once, as arrays.

The fold follows the model. A byte-pair model joins, again and again, the two
neighbours whose joint piece has the best score, the leftmost of equals; its
scores are ranks of merges, not log probabilities, so a path with the best sum
(Viterbi) is not its encoding. A unigram model is folded by Viterbi.

Texts are read where they are, and nothing is shuffled. A model is a table of
some ten thousand pieces, whose size does not depend on the data.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

#: The public model whose file is read by default.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
#: Code points of a block, and of a slice of its distinct words.
BLOCK, SLICE = 1 << 20, 1 << 17
#: Rows that are taken from a batch at once.
ROWS = 1024
#: A word longer than this is folded on its own.
LONG = 64
_NONE = np.iinfo(np.int32).max


@dataclass
class Pieces:
    """A model: pieces by id with scores, the id of byte 0, and whether it is a byte-pair model."""

    text: list[str]
    score: np.ndarray
    normal: np.ndarray
    byte0: int
    unknown: int
    pairs: bool

    def __post_init__(self) -> None:
        ids = np.flatnonzero(self.normal)
        chars = "".join(self.text[i] for i in ids)
        size = np.array([len(self.text[i]) for i in ids])
        ends = np.cumsum(size)
        self.longest = int(size.max())
        self.chars, self.first = codes(chars), np.zeros(len(self.text), np.int64)
        self.first[ids] = ends - size
        key = np.zeros(len(ids), np.uint64)
        for k in range(self.longest):
            on = size > k
            key[on] = T.mix(key[on] ^ self.chars[(ends - size)[on] + k].astype(np.uint64))
        order = np.argsort(key)
        self.key, self.id = key[order], ids[order].astype(np.int32)
        if len(np.unique(key)) < len(key):
            raise ValueError("two pieces of the model have the same hash")
        # Keys are in order; those that begin with the same 18 bits stand from one entry of slots to the next.
        self.slots = np.searchsorted(self.key >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
        # A lower rank is a better score; equal scores rank by id.
        rank = np.lexsort((np.arange(len(self.text)), -self.score))
        self.rank = np.empty(len(self.text), np.int32)
        self.rank[rank] = np.arange(len(self.text), dtype=np.int32)
        inner = sorted({c for i in ids if len(self.text[i]) > 1 for c in self.text[i]})
        self.joining = np.zeros(0x110000, bool)
        self.joining[[ord(c) for c in inner]] = True
        self.by_rank = rank.astype(np.int32)
        # What each id decodes to, as bytes: control ids nothing, the marker a space.
        raw = [bytes([i - self.byte0]) if self.byte0 >= 0 and 0 <= i - self.byte0 < 256 else t.replace("▁", " ").encode() if self.normal[i] else b"" for i, t in enumerate(self.text)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def lookup(self, key: np.ndarray, chars: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
        """The piece that is chars[where : where + k], whose hash is key, or -1. What has a piece's hash is held against its characters."""
        out = np.full(len(key), -1, np.int32)
        slot = (key >> np.uint64(46)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        on, hits, founds = np.flatnonzero(at < end), [], []
        at, end = at[on], end[on]
        while len(on):
            same = self.key[at] == key[on]
            hits.append(on[same])
            founds.append(self.id[at[same]])
            rest = ~same & (at + 1 < end)
            on, at, end = on[rest], at[rest] + 1, end[rest]
        hit, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hits, founds))
        right = np.ones(len(hit), bool)
        for j in range(k):
            right &= chars[where[hit] + j] == self.chars[np.minimum(self.first[found] + j, len(self.chars) - 1)]
        out[hit[right]] = found[right]
        return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def load(path: str = MODEL) -> Pieces:
    """Read a model file on the driver; tasks get the table, not the file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    score = np.array([sp.get_score(i) for i in range(n)])
    normal = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
    text = [sp.id_to_piece(i) for i in range(n)]
    used = score[normal]
    pairs = bool((used == np.floor(used)).all())
    return Pieces(text, score, normal, text.index("<0x00>") if "<0x00>" in text else -1, sp.unk_id(), pairs)


def edges(chars: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> np.ndarray:
    """At [i, k] the rank of the piece that is chars[i : i + k + 1], within the word of i, or _NONE."""
    word_end = np.zeros(len(chars), np.int64)
    word_end[start] = end
    word_end = np.maximum.accumulate(word_end)
    out = np.full((len(chars), pieces.longest), _NONE, np.int32)
    at, key = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
    for k in range(1, pieces.longest + 1):
        inside = at + k <= word_end[at]
        at, key = at[inside], key[inside]
        if not len(at):
            break
        key = T.mix(key ^ chars[at + k - 1].astype(np.uint64))
        found = pieces.lookup(key, chars, at, k)
        hit = found >= 0
        out[at[hit], k - 1] = pieces.rank[found[hit]]
    return out


def _merge(lattice: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lengths of the symbols that begin at each place (0: none does), by joining neighbours, one pair a word a round."""
    size = np.zeros(len(lattice) + 1, np.int64)
    longest = lattice.shape[1]
    for s, e in zip(start[end - start > LONG], end[end - start > LONG], strict=True):
        size[s:e] = _merge_long(lattice[s:e])
    keep = end - start <= LONG
    start, end = start[keep], end[keep]
    lengths = end - start
    symbol = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    size[symbol] = 1
    word = np.repeat(np.arange(len(start)), lengths)
    span = np.ones(len(symbol), np.int64)
    while len(symbol):
        cost = np.full(len(symbol), _NONE, np.int32)
        joint = span[:-1] + span[1:]
        can = np.flatnonzero((word[:-1] == word[1:]) & (joint <= longest))
        cost[can] = lattice[symbol[can], joint[can] - 1]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        best = np.minimum.reduceat(cost, first)
        counts = np.diff(np.append(first, len(word)))
        alive = np.repeat(best < _NONE, counts)
        match = np.flatnonzero(alive & (cost == np.repeat(best, counts)))
        take = match[np.append(True, word[match[1:]] != word[match[:-1]])] if len(match) else match  # the leftmost of each word
        span[take] += span[take + 1]
        alive[take + 1] = False
        size[symbol[take]] = span[take]
        size[symbol[take + 1]] = 0
        symbol, span, word = symbol[alive], span[alive], word[alive]
    return size[:-1]


def _merge_long(lattice: np.ndarray) -> np.ndarray:
    """_merge for one word of any length, with a queue of pairs."""
    n, longest = lattice.shape
    size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))

    def pair(i: int) -> None:
        j = after[i]
        if j < n and size[i] + size[j] <= longest and (rank := int(lattice[i, size[i] + size[j] - 1])) < _NONE:
            heapq.heappush(queue, (rank, i, size[i], size[j]))

    queue: list[tuple[int, int, int, int]] = []
    for i in range(n - 1):
        pair(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if size[i] != a or j >= n or size[j] != b:
            continue
        size[i], size[j], after[i] = a + b, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
        pair(i)
        if before[i] >= 0:
            pair(before[i])
    return np.array(size)


def _viterbi(lattice: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Lengths of symbols on the path with the best sum of scores; a place without a piece costs more than any."""
    n, longest = lattice.shape
    size = np.zeros(n, np.int64)
    score = pieces.score[pieces.by_rank]
    lost = float(score.min()) - 10
    lengths = end - start
    best, back = np.full(n + len(start) + 1, -np.inf), np.ones(n + len(start) + 1, np.int64)
    base = start + np.arange(len(start))  # a word of n places has n + 1 nodes
    best[base] = 0
    for e in range(1, int(lengths.max(initial=0)) + 1):
        on = np.flatnonzero(lengths >= e)
        for k in range(1, min(longest, e) + 1):
            rank = lattice[start[on] + e - k, k - 1]
            value = np.where(rank < _NONE, score[np.minimum(rank, len(score) - 1)], lost if k == 1 else -np.inf) + best[base[on] + e - k]
            better = value > best[base[on] + e]
            best[base[on[better]] + e], back[base[on[better]] + e] = value[better], k
    at, on = lengths.copy(), np.flatnonzero(lengths > 0)
    while len(on):
        k = back[base[on] + at[on]]
        at[on] -= k
        size[start[on] + at[on]] = k
        on = on[at[on] > 0]
    return size


def distinct(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the different words among chars[start:end], and for each word which of them it is; characters decide, not hashes."""
    raw = chars.view(np.uint8)
    key = T.span_hash(raw, start * 4, end * 4)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    size = end - start
    other = size != size[one][which]
    each, k, on = T.eights(raw), 0, np.flatnonzero(~other & (one[which] != np.arange(len(start))))
    while len(on):
        a, b = start[on] + k, start[one[which[on]]] + k
        last = k + 1 == size[on]
        differ = np.where(last, chars[a] != chars[b], each[a * 4] != each[b * 4])
        other[on[differ]] = True
        k += 2
        on = on[~differ & (size[on] > k)]
    for i in np.flatnonzero(other):  # words that share a hash with another one
        match = [j for j in range(len(one)) if key[one[j]] == key[i] and size[one[j]] == size[i] and (chars[start[one[j]] : end[one[j]]] == chars[start[i] : end[i]]).all()]
        if not match:
            match, one = [len(one)], np.append(one, i)
        which[i] = match[0]
    return one, which


def encode_words(chars: np.ndarray, start: np.ndarray, end: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words chars[start:end], in a row, and how many each has."""
    lattice = edges(chars, start, end, pieces)
    size = _merge(lattice, start, end) if pieces.pairs else _viterbi(lattice, start, end, pieces)
    at = np.flatnonzero(size)
    rank = lattice[at, size[at] - 1]
    known = rank < _NONE
    ids = np.where(known, pieces.by_rank[np.minimum(rank, len(pieces.by_rank) - 1)], pieces.unknown).astype(np.int32)
    count = np.ones(len(at), np.int64)
    if pieces.byte0 >= 0 and not known.all():
        raw = {int(i): chr(int(chars[at[i]])).encode() for i in np.flatnonzero(~known)}
        for i, b in raw.items():
            count[i] = len(b)
        ids = np.repeat(ids, count)
        first = np.cumsum(count) - count
        for i, b in raw.items():
            ids[first[i] : first[i] + len(b)] = np.frombuffer(b, np.uint8).astype(np.int32) + pieces.byte0
    word = np.searchsorted(start, at, "right") - 1
    return ids, np.bincount(word, count, len(start)).astype(np.int64)


def encode(texts: list[str | None], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and offsets of the texts in them."""
    marked = ["▁" + t if t else "" for t in texts]
    ends = np.cumsum([len(t) for t in marked], dtype=np.int64)
    chars = codes("".join(marked)).copy()
    chars[chars == 0x20] = SPACE
    n = len(chars)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space, alone = chars == SPACE, ~pieces.joining[chars]
    begin = np.zeros(n + 1, bool)
    begin[1:n] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    begin[np.append(0, ends)] = True
    bounds = np.flatnonzero(begin)
    start, end = bounds[:-1], bounds[1:]
    one, which = distinct(chars, start, end)
    one_start, one_size = start[one], (end - start)[one]
    slices = np.searchsorted(np.cumsum(one_size), np.arange(SLICE, one_size.sum() + SLICE, SLICE), "right")
    ids, counts = [], []
    for i, j in zip(np.append(0, slices[:-1]), slices, strict=True):
        j = max(j, i)
        if i == j:
            continue
        sizes = one_size[i:j]
        to = np.cumsum(sizes)
        take = np.repeat(one_start[i:j] - (to - sizes), sizes) + np.arange(to[-1])
        x, c = encode_words(chars[take], to - sizes, to, pieces)
        ids.append(x)
        counts.append(c)
    done = int(slices[-1]) if len(slices) else 0
    if done < len(one):  # a word longer than a slice
        sizes = one_size[done:]
        to = np.cumsum(sizes)
        take = np.repeat(one_start[done:] - (to - sizes), sizes) + np.arange(to[-1])
        x, c = encode_words(chars[take], to - sizes, to, pieces)
        ids.append(x)
        counts.append(c)
    flat, count = np.concatenate(ids), np.concatenate(counts)
    first = np.cumsum(count) - count
    size = count[which]
    at = np.cumsum(size)
    out = flat[np.repeat(first[which] - (at - size), size) + np.arange(at[-1])]
    text_word = np.searchsorted(start, np.append(0, ends))
    return out, np.append(0, at)[text_word]


def decode_all(ids: np.ndarray, bounds: np.ndarray, pieces: Pieces) -> list[str]:
    """The texts of lists of ids, list i being ids[bounds[i] : bounds[i + 1]]; bytes that make no UTF-8 become U+FFFD."""
    size = pieces.raw_size[ids]
    ends = np.append(0, np.cumsum(size))
    flat = pieces.raw[np.repeat(pieces.raw_at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    at = ends[bounds].tolist()
    texts = [flat[s:e].decode("utf-8", "replace").removeprefix(" ") for s, e in zip(at[:-1], at[1:], strict=True)]
    return [t.replace("▁", " ") if "▁" in t else t for t in texts]


def decode(ids: list[int] | None, pieces: Pieces) -> str | None:
    """The text of ids."""
    return None if ids is None else decode_all(np.array(ids, np.int64), np.array([0, len(ids)]), pieces)[0]


def encoded_batches(pieces: Pieces):
    """Batches with ids and n_tokens in the place of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.small(batches, ROWS):
            texts, i = batch.column("text").to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < BLOCK):
                    size += len(texts[j] or "")
                    j += 1
                ids, at = encode(texts[i:j], pieces)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                yield T.with_columns(batch.slice(i, j - i).drop_columns(["text"]), {"ids": lists, "n_tokens": pa.array(np.diff(at), pa.int64())})
                i = j

    return run


def decoded_batches(pieces: Pieces):
    """Batches with text in the place of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.small(batches, ROWS):
            lists = batch.column("ids")
            bounds = np.append(0, np.cumsum(lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False)))
            texts = decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds, pieces)
            known = lists.is_valid().to_pylist()
            yield T.with_columns(batch.drop_columns(["ids"]), {"text": pa.array([t if k else None for t, k in zip(texts, known, strict=True)], pa.string())})

    return run


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs without text, with ids and n_tokens.

    Defined cases: a null or empty text has no ids; a character without a piece
    becomes its bytes; equal texts get equal ids; U+2581 counts as a space, as
    the model has it; columns of docs by these names are replaced, others pass.
    """
    docs = docs.drop("ids", "n_tokens")
    return docs.mapInArrow(encoded_batches(pieces), T.schema_of([f for f in docs.schema if f.name != "text"], "ids array<int>", "n_tokens bigint"))


def decoded(rows: DataFrame, pieces: Pieces) -> DataFrame:
    """rows with text in place of ids; a null list has a null text, an empty one an empty text; an input column text is replaced."""
    return rows.mapInArrow(decoded_batches(pieces), T.schema_of([f for f in rows.schema if f.name not in ("ids", "text")], "text string"))


def op8_sentencepiece(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document's ids, and the SHA-256 of the text that they decode to.

    Both ways are taken in one pass, so that neither ids nor texts go back and forth.
    """
    pieces = load(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in encoded_batches(pieces)(batches):
            for back in decoded_batches(pieces)(iter([rows.select(["ids"])])):
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in back.column("text").to_pylist()]
                yield T.with_columns(rows, {"text_sha256": pa.array(digests, pa.string())})

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(run, T.schema_of([docs.schema["doc_id"]], "ids array<int>", "n_tokens bigint", "text_sha256 string"))
