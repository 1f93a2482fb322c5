"""Near-duplicate documents: sketches by rounds of hashed bins, banding, and a check on whole sets.

A document is the set of its shingles of SHINGLE words. Documents with equal
sets are one class, so copies are never paired. The sketch of a set has BINS
coordinates: in round i each element is thrown into one bin by a hash of its
own, and a bin keeps the smallest (round, hash) it has seen; a set stays in
play until all its bins are filled, and BINS further rounds throw everything
into one fixed bin each, which fills what is left. Two sets agree in a bin with
the probability of their similarity. Bands of ROWS bins are buckets; sets that
are 85 % alike meet in none of BANDS buckets with probability below 1e-8.

Candidates are leaders of a bucket against its members: a round compares each
bucket's leaders with the members that are not yet known to be connected to
them, then a bucket whose members are all connected is done, and the others go
on with new leaders, eight times as many, until a bucket has no member left
that hasn't led. A set leaves its buckets when what no other set has rules out
any link; after the first leaders, sets with a rare element in common are
compared by it, RARE to an element at most, and such elements count as their
own from then on. So sets meet in pairs only if nearly all they have is common
and they still are not linked, and then once, in their first common bucket.
Each pair is confirmed on the full sets, by two independent 64-bit hashes of
each shingle, so no link that the bands show is lost and none is false.

How the plan grows: shuffled are BANDS rows for each distinct set, the texts of
those sets that share a bucket, and a pair for each member and leader. Rows of
classes and components with very many rows are dealt out (_join.answered).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._join import answered
from ._store import release, stored
from .components import components

SHINGLE = 5
ROWS, BANDS = 5, 32
#: Sets that may have an element which is still rare, in groups that the first leaders have left open.
RARE = 8
BINS = ROWS * BANDS
_MULTIPLIERS = T.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent hashes of the distinct shingles of each text, sorted within it by the first, and bounds: text i has [bounds[i], bounds[i + 1])."""
    data = T.lower(data)
    start, end, first = T.words(data, offsets)
    count = np.diff(first)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(len(count)), made)
    at = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made))
    size = np.minimum(count, k)[text]
    short = bool((size < k).any())
    both = []
    for lane in (0, 1):
        h = T.span_hash(data, start, end, lane)
        value = size.astype(np.uint64) * _MULTIPLIERS[k + lane]
        for j in range(k):
            if short:
                has = size > j
                value[has] += h[at[has] + j] * _MULTIPLIERS[j + 8 * lane]
            else:
                value += h[at + j] * _MULTIPLIERS[j + 8 * lane]
        both.append(T.mix(value))
    order = np.lexsort((both[0], text))
    value, other, text = both[0][order], both[1][order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (other[1:] != other[:-1]) | (text[1:] != text[:-1])
    value, other, text = value[new], other[new], text[new]
    return value, other, np.searchsorted(text, np.arange(len(count) + 1))


def sketches(value: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of bins for each set that isn't empty; rows of empty sets are left full."""
    sizes = np.diff(bounds)
    out = np.full((len(sizes), bins), _FULL, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for i in range(2 * bins):
        if not len(value):
            break
        h = T.mix(value ^ _MULTIPLIERS[i % 64] ^ (np.uint64(i) << np.uint64(32)))
        at = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32) if i < bins else np.full(len(h), i - bins, np.uint64)
        np.minimum.at(flat, owner * bins + at.astype(np.int64), np.uint64(i) << np.uint64(48) | (T.mix(h) >> np.uint64(16)))
        open_ = (out == _FULL).any(1)
        keep = open_[owner]
        value, owner = value[keep], owner[keep]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A hash for each band of ROWS bins, the band's number in it."""
    cut = sketch.reshape(len(sketch), -1, ROWS)
    out = np.broadcast_to(np.arange(cut.shape[1], dtype=np.uint64), cut.shape[:2]).copy()
    for j in range(ROWS):
        out = T.mix(out * _MULTIPLIERS[7] + cut[:, :, j])
    return out.view(np.int64)


def class_keys(value: np.ndarray, other: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bytes that stand for a set: a sum of each of the two independent hashes of its elements."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    for j, (lane, salt) in enumerate(((value, 0x1F83D9ABFB41BD6B), (other, 0x5BE0CD19137E2179))):
        if len(full):
            out[full, j] = T.mix(np.add.reduceat(T.mix(lane ^ np.uint64(salt)), bounds[:-1][full]) + np.diff(bounds)[full].astype(np.uint64))
    return out


def _binary(keys: np.ndarray, valid: np.ndarray) -> pa.Array:
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())])
    return pa.array([None if not ok else raw[i].as_py() for i, ok in enumerate(valid)], pa.binary())


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        for i, j, part, at in T.blocks(data, offsets):
            value, other, bounds = shingles(part, at)
            n = np.diff(bounds)
            flat = bands(sketches(value, bounds))
            flat = flat[n > 0].reshape(-1)
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            rows = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_shingles": pa.array(n, pa.int64()), "cls": _binary(class_keys(value, other, bounds), n > 0), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))}
            yield pa.RecordBatch.from_pydict(rows)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        for _, _, part, at in T.blocks(data, offsets):
            value, other, bounds = shingles(part, at)
            keys = class_keys(value, other, bounds)
            halves = {f"key{j}": pa.array(np.ascontiguousarray(keys[:, j]).view(np.int64), pa.int64()) for j in (0, 1)}
            lists = {c: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x.view(np.int64), pa.int64())) for c, x in (("items", value), ("others", other))}
            yield pa.RecordBatch.from_pydict({"cls": _binary(keys, np.diff(bounds) > 0)} | lists | halves)


def _own(sets: DataFrame) -> DataFrame:
    """(cls, n, own): the size of each set and how many of its elements are in no other one."""
    each = sets.select("key0", "key1", F.explode("items").alias("item"))
    single = each.groupBy("item").agg(F.count(F.lit(1)).alias("__m"), F.min("key0").alias("key0"), F.min("key1").alias("key1")).filter("__m = 1")
    counts = single.groupBy("key0", "key1").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("cls", "key0", "key1", F.size("items").alias("n")).join(counts, ["key0", "key1"], "left").select("cls", "n", F.coalesce("own", F.lit(0)).alias("own"))


def _rare(sets: DataFrame, most: int) -> DataFrame:
    """(cls, item): the elements that at most so many of these sets have."""
    each = sets.select("cls", F.explode("items").alias("item"))
    few = each.groupBy("item").agg(F.count(F.lit(1)).alias("__m")).filter(F.col("__m") <= most).select("item")
    return each.join(few, "item")


def _linkable(n: Column, own: Column, percent: int) -> Column:
    """Whether a set can be alike to any: at best to what is left of it without what no other has."""
    return (n - own) * 100 >= n * percent


def _possible(n: Column, own: Column, m: Column, other: Column, percent: int) -> Column:
    """Whether sets of sizes n and m can be alike, as what only one of them has is in no intersection."""
    both = F.least(n - own, m - other)
    return both * 100 >= (n + m - both) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of classes whose whole sets are alike.

    Elements count as common if they are in either of two independent hashes:
    the smaller count is right unless both err at once (128 bits).
    """
    x = sets.select(F.col("cls").alias("b"), F.col("items").alias("__y"), F.col("others").alias("__v"))
    y = sets.select(F.col("cls").alias("a"), F.col("items").alias("__x"), F.col("others").alias("__u"))
    both = F.least(F.size(F.array_intersect("__x", "__y")), F.size(F.array_intersect("__u", "__v")))
    joined = pairs.join(x, "b").join(y, "a").select("a", "b", both.alias("__both"), (F.size("__x") + F.size("__y")).alias("__sum"))
    return joined.filter(F.col("__both") * 100 >= (F.col("__sum") - F.col("__both")) * percent).select("a", "b")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls, bands) for each row of docs; cls is null and bands empty for a text without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_signed, f"doc_id {kind}, n_shingles bigint, cls binary, bands array<bigint>")


def classes_of(signed: DataFrame) -> DataFrame:
    """(cls, one, copies, bands) for each class: its smallest doc_id, and how many rows it has."""
    return signed.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("one"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))


def linked(docs: DataFrame, classes: DataFrame, percent: int = 85) -> DataFrame:
    """(cls, comp): for each class that is linked to another, the smallest class it reaches; classes as of classes_of()."""
    members = classes.select("cls", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("__m")).filter("__m > 1").drop("__m")
    members = stored(members.join(buckets, "band"), "near-buckets")
    docs = docs.select("doc_id", "text")
    chosen = classes.join(members.select("cls").distinct(), "cls").select(F.col("one").alias("__id")).distinct()
    picked = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    sets = picked.mapInArrow(_sets, "cls binary, items array<bigint>, others array<bigint>, key0 bigint, key1 bigint").filter("cls is not null").dropDuplicates(["cls"])
    sets = stored(sets, "near-sets")
    members = stored(members.join(_own(sets), "cls").filter(_linkable(F.col("n"), F.col("own"), percent)), "near-members")
    links, shapes, comps, many = None, None, members.select("cls", F.col("cls").alias("comp")).limit(0), 1
    while True:
        named = members.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        open_ = named.groupBy("band").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).filter("__lo != __hi").select("band")
        named = stored(named.join(open_, "band", "left_semi"), "near-open")
        release(members)
        if named.isEmpty():
            return comps
        kept = ["cls", "comp", "n", "own"]
        if many > 1:
            # What two sets have in one bucket they often have in many; only the first of these pairs them.
            kept.append("bands")
        if many > 1 and shapes is None:
            left = stored(named.select("cls").distinct(), "near-left")
            shapes = stored(classes.join(left, "cls").select("cls", "bands"), "near-shapes")
            # Sets with a rare element in common are compared at once, by that element; two others
            # then have none of their rare elements in common, which rules most of the rest out.
            rare = stored(_rare(sets.select("cls", "items").join(left, "cls", "left_semi"), RARE), "near-rare")
            sizes = named.select("cls", "comp", "n", "own").dropDuplicates(["cls"])
            x, y = (rare.select(F.col("cls").alias(c), "item") for c in "ab")
            met = x.join(y, "item").filter("a < b").select("a", "b").distinct()
            for c in "ab":
                met = met.join(sizes.select(F.col("cls").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("comp", "n", "own")]), c)
            met = met.filter((F.col("comp_a") != F.col("comp_b")) & _possible(F.col("n_a"), F.col("own_a"), F.col("n_b"), F.col("own_b"), percent)).select("a", "b")
            found = stored(confirmed(met, sets, percent), "near-links")
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                comps = components(links)
            counts = rare.groupBy("cls").agg(F.count(F.lit(1)).cast("int").alias("own"))
            rest = named.select("band", "cls", "n").join(counts, "cls", "left").withColumn("own", F.coalesce("own", F.lit(0)))
            members = stored(rest.filter(_linkable(F.col("n"), F.col("own"), percent)), "near-rest")
            release(named, rare, left)
            continue
        # Those go first that share most of what they have: in a group of near copies the rest is linked through them.
        first = F.min_by("cls", F.struct("own", "cls")).alias("cls")
        led = named.groupBy("band", F.pmod(F.hash("cls"), F.lit(many)).alias("__salt")).agg(first).select("band", "cls", F.lit(True).alias("led"))
        marked = named.join(led, ["band", "cls"], "left").withColumn("led", F.coalesce("led", F.lit(False)))
        marked = stored(marked.join(shapes, "cls") if many > 1 else marked, "near-marked")
        release(named)
        leaders = marked.filter("led").select(F.col("band").alias("__band"), *[F.col(c).alias(f"__{c}") for c in kept])
        meet = (F.col("band") == F.col("__band")) & (F.col("comp") != F.col("__comp")) & _possible(F.col("n"), F.col("own"), F.col("__n"), F.col("__own"), percent)
        # Of two leaders of a bucket, one meets the other.
        meet &= ~F.col("led") | (F.col("__cls") < F.col("cls"))
        if many > 1:
            shared = F.array_position(F.zip_with("bands", "__bands", lambda x, y: x == y), True)
            meet &= F.element_at("bands", shared.cast("int")) == F.col("band")
        pairs = marked.join(leaders, meet).select(F.least("__cls", "cls").alias("a"), F.greatest("__cls", "cls").alias("b")).distinct()
        found = stored(confirmed(pairs, sets, percent), "near-links")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            comps = components(links)
        members = stored(marked.filter("not led").select("band", "cls", "n", "own"), "near-rest")
        release(marked)
        many *= 8


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, cls), a row for each row of docs.

    component_id is the smallest doc_id among the rows that links reach, and a
    row is kept if its doc_id is that. Defined cases: a text without words, and
    a null text, has an empty set, is linked with nothing and is kept; a null
    doc_id counts only where a component has no other, and its rows are then
    kept; rows that repeat a doc_id are nodes of their own; an empty table
    gives an empty one; other columns of docs play no part.
    """
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs), "near-signed")
    names = _names(docs, signed, percent)
    out = answered(signed.select("doc_id", "n_shingles", "cls"), names.drop("one"), {"cls": "__cls"})
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("__least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "cls")


def _names(docs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(__cls, one, copies, __least): for each class its smallest doc_id, its rows, and the smallest doc_id of its component."""
    # Sums and joins by class or component stand in different stages, so that Spark may split a large one.
    classes = stored(classes_of(signed), "near-classes")
    comps = linked(docs, classes, percent)
    classes = stored(classes.select("cls", "one", "copies").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "near-named")
    least = stored(classes.groupBy(F.col("comp").alias("__comp")).agg(F.min("one").alias("__least"), F.count(F.lit(1)).alias("__many")), "near-least")
    return stored(answered(classes, least, {"comp": "__comp"}, "__many").select(F.col("cls").alias("__cls"), "one", "copies", "__least"), "near-names")


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, repeats of a kept row left out."""
    signed = stored(signatures(docs.select("doc_id", "text")), "near-signed")
    kept = _names(docs.select("doc_id", "text"), signed, percent).filter("one <=> __least").select(F.col("one").alias("__id"), F.col("__cls").alias("__c"))
    named = docs.mapInArrow(_named, T.schema_of(docs.schema, "__cls binary"))
    full = named.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__cls") == F.col("__c")), "left_semi").dropDuplicates(["doc_id", "__cls"])
    return full.unionByName(named.filter("__cls is null")).select(*docs.columns)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = T.buffers(batch.column("text"))
        found = []
        for _, _, part, at in T.blocks(data, offsets):
            value, other, bounds = shingles(part, at)
            found.append(_binary(class_keys(value, other, bounds), np.diff(bounds) > 0))
        yield T.with_columns(batch, {"__cls": pa.concat_arrays(found) if found else pa.array([], pa.binary())})


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Documents that are 85 % alike in their shingles of five words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85).drop("cls")
