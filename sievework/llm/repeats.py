"""Repeated passages: every byte inside a string of LENGTH bytes that also starts elsewhere goes.

Anchors. In each string of LENGTH bytes, the GRAM bytes with the smallest hash
(the leftmost of equals) are its anchor, so equal strings have equal anchors at
equal places, and only about one byte in eighty is an anchor. The strings with
one anchor start in one stretch; from its first to the end of its last string
is the anchor's context. Anchors deal the strings to groups: equal strings are
in one group, and a group of one context has nothing to compare.

Interval expansion. The different contexts of a group go, whole groups
together, into blocks whose suffixes are sorted. From the block's
Burrows-Wheeler transform, backward extension of intervals, level by level from
the empty string, yields the common prefixes of neighbours in increasing order:
at level d each new right end is a boundary between neighbours that share d
bytes. It stops at LENGTH; neighbours without a boundary share that much.
Contexts that are copies of one another go into it once, and are repeats whole.

Groups of more than GROUP different contexts are dealt out further before that:
the strings that start between a and b bytes before the anchor share a core,
which with the range is the key of a smaller group; ranges are halved until a
group fits. At worst a range is one place and its core the string itself. So
every group, whatever its size, is decided by the expansion.

Contexts are told apart by 160 bits of two hashes, texts by SHA-256. A hash of
anchors or cores that two share costs time only, as the expansion compares
bytes. Shuffled are rows of anchors (about 34 bytes for 80 bytes of text), the
texts with undecided anchors, and each text once more to be cut; rows of copies
beyond measure are dealt out (_join.answered).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._join import answered
from ._store import release, stored

LENGTH, GRAM = 200, 24
#: Contexts with one anchor that go into one block at most, and the bytes of a block.
GROUP, BLOCK_BYTES = 3072, 1 << 19


def text_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each text's SHA-256, as two numbers."""
    both = np.frombuffer(b"".join(hashlib.sha256(data[s:e]).digest()[:16] for s, e in zip(offsets[:-1], offsets[1:], strict=True)), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def context_keys(data: np.ndarray, low: np.ndarray, high: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of a hash of each data[low:high] and its salt."""
    view = memoryview(np.ascontiguousarray(data))
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(low.tolist(), high.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    c = T.mix(both[:, 0] ^ T.mix(salt.astype(np.uint64)))
    return c.view(np.int64), (T.mix(both[:, 1] + c) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all texts, and the first and the last start of the strings that each is the anchor of."""
    n, width = int(offsets[-1]), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    # This hash puts grams in an order and nothing else: two that share it are ordered by place.
    x = T.eights(data)[:n] * np.uint64(0x9E3779B97F4A7C55)
    x ^= x >> np.uint64(29)
    best, count = np.zeros(n - gram + 1, np.uint64), n - gram + 1
    for j, at in enumerate(sorted({*range(0, gram - 8, 8), gram - 8})):
        best += x[at : at + count] * np.uint64(0xBF58476D1CE4E5B9 + 2 * j)
        best ^= best >> np.uint64(31)
    best *= np.uint64(0x94D049BB133111EB)
    best &= np.uint64(0xFFFFFFFF00000000)
    best |= np.arange(count, dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < width:
        best = np.minimum(best[: len(best) - (width - step)], best[width - step :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(best)]
    start = np.flatnonzero(np.arange(len(best)) + length <= ends)
    place = (best[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    return place[new], start[new], start[np.append(new[1:], len(place)) - 1] if len(place) else start


_ANCHOR = "h:bigint,c:bigint,d:int,pos:int,before:smallint,size:smallint"


def _anchored(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column("text"))
            for i, j, part, at in T.blocks(data, offsets):
                k0, k1 = text_keys(part, at)
                place, low, high = anchors(part, at, length, gram)
                high = high + length
                text = np.searchsorted(at, place, "right") - 1
                c, d = context_keys(part, low, high, place - low)
                fields = {"h": T.span_hash(part, place, place + gram).view(np.int64), "c": c, "d": d, "pos": (place - at[:-1][text]).astype(np.int32), "before": (place - low).astype(np.int16), "size": (high - low).astype(np.int16)}
                each = pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields))
                ends = np.searchsorted(text, np.arange(len(at))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(i, j - i), "k0": pa.array(k0), "k1": pa.array(k1), "at": pa.ListArray.from_arrays(pa.array(ends), each)})

    return run


def _with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = text_keys(*T.buffers(batch.column("text")))
        yield T.with_columns(batch, {f"k{j}": pa.array(keys[j]) for j in (0, 1)})


def slices(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """data[low:high] for each, as an Arrow array."""
    size = high - low
    ends = np.cumsum(size)
    taken = data[np.repeat(low - (ends - size), size) + np.arange(int(size.sum()))]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(taken)])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each place listed for a text."""
    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        for i, j, part, at in T.blocks(data, offsets):
            places = batch.column("places").slice(i, j - i)
            text = np.repeat(np.arange(j - i), places.value_lengths().to_numpy(zero_copy_only=False))
            flat = places.flatten()
            each = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
            pos, before, size = (each[x].to_numpy().astype(np.int64) for x in ("pos", "before", "size"))
            low = at[text] + pos - before
            out = {c: each[c] for c in ("h", "c", "d", "pos", "before", "whole", "many")} | {"bytes": slices(part, low, low + size)}
            out |= {k: batch.column(k).slice(i, j - i).take(pa.array(text)) for k in ("k0", "k1")}
            yield pa.RecordBatch.from_pydict({c: out[c] for c in ("h", "c", "d", "k0", "k1", "pos", "before", "bytes", "whole", "many")})


def suffix_order(symbols: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first depth symbols at least, and each one's place, by doubling.

    symbols are from 0 to 256; a 0 ends a context, left[i] symbols after i.
    What follows a 0 is not compared, so equal ends stand in any order.
    """
    n, reach = len(symbols), 7
    key = np.zeros(n, np.int64)
    for k in range(reach):
        key[: n - k] |= np.where(left[: n - k] > k, symbols[k:], 0) << (9 * (reach - 1 - k))
    rank = np.zeros(n + 1, np.int64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        rank[order] = np.cumsum(new)
        if reach >= depth or new.all():
            break
        ahead = np.minimum(np.arange(n) + reach, n)
        key = rank[:n] * (n + 2) + np.where(left > reach, rank[ahead], 0)
        reach *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def boundaries(symbols: np.ndarray, order: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """For each place in the order, whether its suffix shares fewer than length symbols with the one before.

    Breadth-first backward extension: a queue holds intervals of suffixes that
    begin with one string of d symbols; extended to the left by a symbol, an
    interval becomes another, whose right end, if it is new, is a boundary of
    value d. A 0 ends a context and extends nothing.
    """
    n = len(order)
    head, before = symbols[order], symbols[order - 1]  # before: the transform
    real, back = before > 0, place[order - 1]
    cut = np.zeros(n + 1, bool)
    cut[0] = cut[n] = True
    cut[: np.count_nonzero(symbols == 0) + 1] = True
    owner, touched = np.full(n, -1, np.int32), np.zeros(n, bool)
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        which = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
        k = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(which))
        keep = real[k]
        k, which = back[k[keep]], which[keep]
        owner[k] = which
        if len(k) * 8 > n:
            touched[:] = False
            touched[k] = True
            k = np.flatnonzero(touched)
        else:
            k = np.sort(k)
        if not len(k):
            break
        mine, first_symbol = owner[k], head[k]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1] + 1) | (mine[1:] != mine[:-1]) | (first_symbol[1:] != first_symbol[:-1])))
        low, high = k[first], k[np.append(first[1:], len(k)) - 1] + 1
        new = ~cut[high]
        cut[high[new]] = True
        low, high = low[new], high[new]
    return cut[:n]


def repeated_starts(data: np.ndarray, sizes: np.ndarray, group: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) in order: strings of length bytes that another context of the group has at the same distance from the anchor.

    data holds the contexts, sizes[i] bytes each, one after the other.
    """
    m = len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(len(data) + m, np.int64)
    solid = np.ones(len(symbols), bool)
    solid[ends] = False
    symbols[solid] = data.astype(np.int64) + 1
    owner = np.repeat(np.arange(m), sizes + 1)
    left = ends[owner] - np.arange(len(symbols))
    order, place = suffix_order(symbols, left, length)
    same = np.cumsum(boundaries(symbols, order, place, length))
    start = sizes[owner] - left
    at = np.flatnonzero(left >= length)
    # One number for string, group and distance.
    key = (same[place[at]] * (int(group.max(initial=0)) + 1) + group[owner[at]]) * (length + 1) + before[owner[at]] - start[at]
    by = np.argsort(key)
    key = key[by]
    equal = key[1:] == key[:-1]
    twice = np.zeros(len(by), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    hit = np.sort(at[by[twice]])
    return owner[hit], start[hit]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = "k0 bigint, k1 bigint, low int, high int"


def _expanded(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, offsets = T.buffers(table.column("bytes"))
        before, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("before", "pos"))
        group = np.unique(table.column("g").to_numpy(), return_inverse=True)[1]
        which, start = repeated_starts(data[offsets[0] : offsets[-1]], np.diff(offsets), group, before, length)
        open_ = ~table.column("whole").to_numpy()[which]
        which, start = which[open_], start[open_]
        new = np.append(True, (which[1:] != which[:-1]) | (start[1:] - start[:-1] > length))[: len(which)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(which))[: len(first)] - 1
        low = pos - before
        of = which[first]
        out = {k: table.column(k).take(pa.array(of)).combine_chunks() for k in ("k0", "k1")}
        return pa.table(out | {"low": pa.array((low[of] + start[first]).astype(np.int32)), "high": pa.array((low[of] + start[last] + length).astype(np.int32))})

    return run


def _ranged(length: int):
    """For ranges [a, b] of distances from a string's start to the anchor: the group g of the core, and the context cut to the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = T.buffers(batch.column("bytes"))
            h, pos, before, a, b = (batch.column(c).to_numpy().astype(np.int64) for c in ("h", "pos", "before", "a", "b"))
            # The core of a range is in every context that holds one of its strings.
            ok = np.flatnonzero((a <= before) & (b >= before + length - np.diff(offsets)))
            origin, h, pos, before, a, b, size = (x[ok] for x in (offsets[:-1] + before, h, pos, before, a, b, np.diff(offsets)))
            near, far = np.minimum(b, before), np.maximum(a, before + length - size)
            low, high = origin - near, origin - far + length
            salt = a * 4096 + b
            core = T.span_hash(data, origin - a, origin + length - b)
            g = T.mix(core ^ T.mix(h.view(np.uint64) ^ T.mix(salt.astype(np.uint64))))
            c, d = context_keys(data, low, high, near)
            rest = batch.take(pa.array(ok)).drop_columns(["bytes", "before"])
            cut = {"g": g.view(np.int64), "c": c, "d": d, "before": near.astype(np.int16)}
            yield T.with_columns(rest, {x: pa.array(v) for x, v in cut.items()} | {"bytes": slices(data, low, high)})

    return run


_PLACE = ("k0", "k1", "pos", "before", "whole", "bytes")


def dealt(contexts: DataFrame, length: int, gram: int, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of groups that have more than group of them, as rows of groups that don't, and spans (_SPANS) of those that occur twice as a whole."""
    parts, sure = [], []
    large = contexts.select("h", *_PLACE, F.lit(0).alias("a"), F.lit(length - gram).alias("b"))
    while True:
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b").alias("b")))).alias("x")
        rows = large.filter("a < b").select("h", *_PLACE, halves).select("h", *_PLACE, "x.a", "x.b")
        rows = stored(rows.mapInArrow(_ranged(length), "h bigint, k0 bigint, k1 bigint, pos int, whole boolean, a int, b int, g bigint, c bigint, d int, before smallint, bytes binary"), "repeat-ranges")
        kinds = stored(rows.groupBy("g", "c", "d").agg(F.count(F.lit(1)).alias("m")), "repeat-kinds")
        groups = stored(kinds.groupBy(F.col("g").alias("__g")).agg(F.count(F.lit(1)).alias("many"), F.sum("m").alias("total")), "repeat-groups")
        known = answered(kinds, groups.select("__g", "many", "total", F.col("many").alias("__n")), {"g": "__g"}, "__n").filter("total > 1")
        known = stored(known.select(*[F.col(x).alias(f"__{x}") for x in "gcd"], "many", "m", (F.col("m") > 1).alias("copied")), "repeat-known")
        judged = stored(answered(rows, known, {x: f"__{x}" for x in "gcd"}, "m", "inner"), "repeat-judged")
        release(rows, kinds, groups, known)
        low = (F.col("pos") - F.col("before")).cast("int")
        sure.append(judged.filter("copied and not whole").select("k0", "k1", low.alias("low"), (low + F.length("bytes")).cast("int").alias("high")))
        # A context that is decided stays for those that share its core; of copies one does.
        several = judged.filter("many > 1")
        several = several.filter("not copied").unionByName(several.filter("copied").dropDuplicates(["g", "c", "d"])).withColumn("whole", F.col("whole") | F.col("copied"))
        parts.append(several.filter(F.col("many") <= group).select("g", *_PLACE))
        large = stored(several.filter(F.col("many") > group).select("h", *_PLACE, "a", "b"), "repeat-large")
        if large.isEmpty():
            return parts, sure


def removed(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of raw without spans, bytes gone, and maximal runs."""
    runs = merged(spans)
    kept, at = [], 0
    for s, e in runs:
        kept.append(raw[at:s])
        at = e
    kept.append(raw[at:])
    return b"".join(kept), sum(e - s for s, e in runs), len(runs)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k0, k1, spans, copies): for each text that repeats anything, by its hash, the ranges of bytes, which may overlap, and its rows."""
    docs = docs.select("doc_id", "text").filter("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(docs.mapInArrow(_anchored(length, gram), f"doc_id {kind}, k0 bigint, k1 bigint, at array<struct<{_ANCHOR}>>"), "repeat-rows")
    # From here on a text stands for all its copies.
    texts = stored(rows.groupBy("k0", "k1").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one"), F.first("at").alias("at")), "repeat-texts")
    release(rows)
    each = texts.select("k0", "k1", "copies", F.inline("at"))
    by_context = each.groupBy("h", "c", "d").agg(F.sum("copies").alias("m"), F.count(F.lit(1)).alias("places"))
    by_anchor = by_context.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.sum("m").alias("total")).filter("total > 1").drop("total")
    known = stored(by_context.join(by_anchor, "h").select(*[F.col(x).alias(f"__{x}") for x in "hcd"], (F.col("m") > 1).alias("whole"), "many", "places"), "repeat-contexts")
    marked = stored(answered(each.drop("copies"), known, {x: f"__{x}" for x in "hcd"}, "places", "inner"), "repeat-marked")
    ones = stored(texts.select("k0", "k1", "one", "copies"), "repeat-ones")
    release(texts, known)
    low = (F.col("pos") - F.col("before")).cast("int")
    spans = stored(marked.filter("whole").select("k0", "k1", low.alias("low"), (low + F.col("size")).cast("int").alias("high")), "repeat-whole")
    several = marked.filter("many > 1")
    several = several.filter("not whole").unionByName(several.filter("whole").dropDuplicates(["h", "c", "d"]))
    places = several.groupBy("k0", "k1").agg(F.collect_list(F.struct("pos", "before", "size", "h", "c", "d", "whole", "many")).alias("places")).join(ones.drop("copies"), ["k0", "k1"])
    places = places.select(F.col("k0").alias("__0"), F.col("k1").alias("__1"), "one", "places")
    named = docs.mapInArrow(_with_keys, T.schema_of(docs.schema, "k0 bigint", "k1 bigint"))
    found = named.join(places, (F.col("k0") == F.col("__0")) & (F.col("k1") == F.col("__1")) & F.col("doc_id").eqNullSafe(F.col("one")))
    found = found.select("text", "k0", "k1", "places").mapInArrow(_contexts, "h bigint, c bigint, d int, k0 bigint, k1 bigint, pos int, before smallint, bytes binary, whole boolean, many bigint")
    # Rows that repeat doc_id and text bring their places twice.
    contexts = stored(found, "repeat-bytes")
    release(marked)
    small = contexts.filter(F.col("many") <= group).select(F.col("h").alias("g"), *_PLACE)
    large = contexts.filter(F.col("many") > group)
    if not large.isEmpty():
        parts, sure = dealt(large.dropDuplicates(["h", "c", "d"]), length, gram, group)
        for part in parts:
            small = small.union(part)
        for part in sure:
            spans = spans.union(part)
    size = small.agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
    blocks = max(1, size // BLOCK_BYTES)
    expanded = small.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(blocks))).groupBy("block").applyInArrow(_expanded(length), _SPANS)
    spans = spans.union(stored(expanded, "repeat-spans"))
    release(contexts)
    return spans.groupBy("k0", "k1").agg(F.collect_set(F.struct("low", "high")).alias("spans")).join(ones.drop("one"), ["k0", "k1"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = (text or "").encode()
            kept, gone, runs = removed(raw, [(s["low"], s["high"]) for s in spans or ()])
            out.append((len(raw), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()))
        yield T.with_columns(batch, {name: pa.array(x, kind) for (name, kind), x in zip(kinds, columns, strict=True)}).drop_columns(["text", "spans", "k0", "k1"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs.

    kept holds the remaining bytes, which need not be UTF-8. Defined cases: a
    null text is empty; a text shorter than length has no repeats; rows with
    equal texts of length bytes or more lose all of them, a repeated row too;
    an empty table gives an empty one; other columns of docs play no part.
    """
    spans = stored(repeated_spans(docs, length, gram, group).select(F.col("k0").alias("__0"), F.col("k1").alias("__1"), "spans", "copies"), "repeat-found")
    docs = docs.select("doc_id", "text")
    named = docs.mapInArrow(_with_keys, T.schema_of(docs.schema, "k0 bigint", "k1 bigint"))
    rows = answered(named, spans, {"k0": "__0", "k1": "__1"})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that occur twice anywhere."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
