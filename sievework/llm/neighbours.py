"""Approximate nearest neighbours by cosine: NN-descent builds graphs, greedy search walks them.

Equal vectors are one node, so copies, however many, are neither compared nor
crowd the lists of others; each dimension has graphs of its own. The nodes of a
dimension are dealt to blocks of about BLOCK: the cells of a spherical k-means
that is fitted on at most FITTED vectors, and parts by hash of cells that are
larger. A block's graph is made in one task, from vectors that are all in its
memory. It begins with the leaves of TREES trees: nodes are halved by planes
between two of them until LEAF are left, each of which is compared with all. A
round of descent then compares, at each node, a sample of its neighbours and of
those that have it as a neighbour, pairs with a new one only: a neighbour's
neighbour is likely a neighbour. Rounds end when one changes less than STABLE of
all entries. Every node is linked to its K and to K that have it as one of theirs.

A query walks the graphs of the cells whose centers are nearest to it. It starts
from the best of a block's every ENTRY-th node and expands, round by round, the
STEP best nodes it hasn't expanded, until its best all have been. How many it
holds is EF in its nearest cell and half of that with each doubling of a cell's
rank; EF and the share of cells are raised until the recall of TRIED queries
against brute force over all vectors is SAFE: so the cost of a query grows as
the data ask.

A vector travels once to its block, as a unit vector of 2 bytes a component, and
a block's graph once to each ASKS of its queries; what a task holds is bounded by
BLOCK and ASKS, and the number of tasks grows with the vectors. All vectors are
indexed; results are approximate, and tests hold recall against brute force.
Scores are computed in double precision from the vectors themselves, for all
that single steps of the 2 bytes could reorder.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._join import answered
from ._store import release, stored, sweep

K, LEAF, TREES, SAMPLE = 24, 256, 4, 12
#: Nodes of a block, and of the least for which a table is cut into up to PARTS of them.
BLOCK, LEAST, PARTS = 1 << 17, 1 << 12, 16
#: The k-means sees so many vectors for each cell, and so many of a dimension at most.
SEEN, FITTED = 256, 1 << 16
#: One in so many nodes of a block is where a walk can begin, and so many of them are where it does.
ENTRY, BEGUN = 64, 32
#: Queries of a block that one task answers, and that walk it side by side.
ASKS, ABREAST = 1 << 16, 64
EF, STEP = 256, 64
#: Descent ends when a round has changed less than this share of all list entries.
STABLE = 0.02
#: The recall that so many queries, searched by brute force too, must reach before the others are searched.
SAFE, TRIED = 0.95, 256
#: No two cosines differ by more than this from those of their 2-byte vectors.
COARSE = 2.5e-3
#: Nodes in a row of a stored graph; pairs that descent finds before it merges them.
ROW, HELD = 1 << 12, 1 << 21

_FOUND = "q bigint, others array<bigint>, sims array<float>"
_GRAPH = "block int, row int, nodes binary, units binary, links binary"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, vec) of the vectors that take part, vec as they are.

    Left out are null ids, null and empty vectors, those with null or
    non-finite components, and those of length zero. Rows that repeat both id
    and vector count once; different vectors with one id are rows of their own.
    """
    vec = F.col(embedding).cast("array<double>")
    least, most, inf = F.array_min(vec), F.array_max(vec), F.lit(float("inf"))
    # What an array holds is unknown, not false, where it has a null; NaN is above all others.
    fine = ~F.array_contains(vec, inf) & (most < inf) & (least > -inf) & ((least != 0) | (most != 0))
    return vectors.filter(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vec")).distinct()


def nodes_of(rows: DataFrame, most: int) -> DataFrame:
    """(node, vec, ids): a node for each different vector, with the smallest of its ids, most at most."""
    # Spark takes the first rows of a key before the shuffle too, so a vector with very many rows is no hot key.
    by_id = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("id")  # hashes sort faster than vectors
    first = rows.withColumn("__at", F.row_number().over(by_id)).filter(F.col("__at") <= most)
    ids = F.array_compact(F.array("id", *[F.lead("id", i).over(by_id) for i in range(1, most)]))
    return first.withColumn("ids", ids).filter("__at = 1").select(F.monotonically_increasing_id().alias("node"), "vec", "ids")


def _scaled(rows: list | np.ndarray) -> np.ndarray:
    """Vectors over a power of two, so that no square overflows or vanishes, and no component is rounded."""
    x = np.array(rows, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _by_dim(sizes: np.ndarray) -> Iterator[np.ndarray]:
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of length 1, 2 bytes a component."""
    for batch in T.small(batches, 4096):
        vectors = batch.column("vec")
        for at in _by_dim(vectors.value_lengths().to_numpy()):
            x = _scaled(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            units = pa.array([u.tobytes() for u in x.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_pydict({"node": batch.column("node").take(pa.array(at)), "unit": units, "dim": pa.array(np.full(len(at), x.shape[1], np.int32))})


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float16).reshape(len(units), -1).astype(np.float32)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


# Cells and blocks


class Cells(NamedTuple):
    """The cells of one dimension: their centers, each one's first block and number of blocks."""

    centers: np.ndarray
    first: np.ndarray
    parts: np.ndarray


def _centers(x: np.ndarray, n: int) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(5)
    centers = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(8):
        mine = (x @ centers.T).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, mine, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centers = np.where(length > 1e-6, total / np.maximum(length, 1e-6), centers)
    return centers


def cells_of(units: DataFrame) -> tuple[dict[int, Cells], int]:
    """The cells of each dimension, and the nodes that the largest block will have, about."""
    sizes = {r.dim: r["count"] for r in units.groupBy("dim").count().collect()}
    wanted = {d: max(ceil(n / BLOCK), min(PARTS, n // LEAST + 1)) for d, n in sizes.items()}
    seen: dict[int, list] = {}
    for d, s in wanted.items():
        if s > 1:
            share = min(FITTED, SEEN * s) / sizes[d]
            some = units.filter((F.col("dim") == d) & (F.pmod(F.xxhash64(F.lit(17), "node"), F.lit(1 << 30)) < int(share * (1 << 30))))
            seen[d] = [r.unit for r in sorted(some.select("node", "unit").collect())]
    out, first, largest = {}, 0, 0
    for d, n in sorted(sizes.items()):
        centers, share = np.zeros((1, d), np.float32), np.ones(1)
        if seen.get(d):
            x = _matrix(seen[d])
            centers = _centers(x, wanted[d])
            share = np.bincount((x @ centers.T).argmax(1), minlength=len(centers)) / len(x)
        parts = np.maximum(1, np.ceil(share * n / (BLOCK * 4 / 3))).astype(np.int64)
        out[d] = Cells(centers, first + np.cumsum(parts) - parts, parts)
        first, largest = first + int(parts.sum()), max(largest, ceil((share * n / parts).max()))
    return out, largest


def _part(node: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (T.mix(node.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)


def _by_cells(batches: Iterator[pa.RecordBatch], cells: dict[int, Cells], size: int) -> Iterator[tuple[Cells, np.ndarray, np.ndarray]]:
    """Nodes of one dimension: its cells, the nodes and their vectors."""
    for batch in T.small(batches, size):
        node, dim, units = batch.column("node").to_numpy(), batch.column("dim").to_numpy(), batch.column("unit").to_pylist()
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            yield cells[int(d)], node[at], _matrix([units[i] for i in at])


def _placed(cells: dict[int, Cells]):
    """Nodes and the blocks that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, node, x in _by_cells(batches, cells, 4096):
            mine = (x @ c.centers.T).argmax(1)
            units = pa.array([u.tobytes() for u in x.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_pydict({"block": pa.array((c.first[mine] + _part(node, c.parts[mine])).astype(np.int32)), "node": pa.array(node), "unit": units})

    return run


def _asks(cells: dict[int, Cells], share: float, ef: int, least: int):
    """Queries at the blocks of the nearest of their cells, that share of them, and how many a walk there holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, node, x in _by_cells(batches, cells, 1024):
            order = np.argsort(-(x @ c.centers.T), 1)[:, : ceil(share * len(c.centers))]
            held = np.maximum(least, ef >> np.log2(np.arange(order.shape[1]) + 1).astype(np.int64))
            row, cell = np.repeat(np.arange(len(node)), order.shape[1]), order.ravel()
            held = np.tile(held, len(node))
            times = c.parts[cell]
            block = np.repeat(c.first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, held = np.repeat(row, times), np.repeat(held, times)
            units = pa.array([u.tobytes() for u in x.astype(np.float16)], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_pydict({"block": pa.array(block.astype(np.int32)), "q": pa.array(node[row]), "query": units, "ef": pa.array(held.astype(np.int32))})

    return run


# The graph of a block: lists others and sims (n, k) of positions, best first, -1 and -9 where there is none


def _best(ids: np.ndarray, sims: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, an entry once; of equal ones that in the leftmost column."""
    order = np.argsort(ids, 1, kind="stable")
    ids, sims, new = (np.take_along_axis(v, order, 1) for v in (ids, sims, new))
    sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -9
    order = np.argsort(-sims, 1, kind="stable")[:, :k]
    ids, sims, new = (np.take_along_axis(v, order, 1) for v in (ids, sims, new))
    return np.where(sims > -5, ids, -1), sims, new & (sims > -5)


def _leaves(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Lists from the leaves of TREES trees."""
    n = len(x)
    others, sims = np.full((n, k), -1, np.int32), np.full((n, k), -9, np.float32)
    for _ in range(TREES):
        leaves = [np.arange(n)]
        while len(leaves[0]) > LEAF:
            halves = []
            for p in leaves:
                a, b = x[p[rng.integers(len(p), size=2)]]
                order, half = np.argpartition(x[p] @ (a - b), len(p) // 2), len(p) // 2
                halves += [p[order[:half]], p[order[half:]]]
            leaves = halves
        for p in leaves:
            sim = x[p] @ x[p].T
            np.fill_diagonal(sim, -9)
            m = min(k, len(p) - 1)
            best = np.argpartition(-sim, m - 1, 1)[:, :m]
            ids, all_sims = np.append(others[p], p[best].astype(np.int32), 1), np.append(sims[p], np.take_along_axis(sim, best, 1), 1)
            others[p], sims[p], _ = _best(ids, all_sims, np.zeros(ids.shape, bool), k)
    return others, sims


def _offered(others: np.ndarray, sims: np.ndarray, new: np.ndarray, to: np.ndarray, other: np.ndarray, sim: np.ndarray) -> None:
    """Merges what is found, which is new, into the lists."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to, other, sim = to[order], other[order], sim[order]
    start = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    size, k = np.diff(np.append(start, len(to))), others.shape[1]
    for lo in range(0, len(start), 4096):
        first, z = start[lo : lo + 4096], size[lo : lo + 4096]
        r, here = to[first], slice(first[0], first[0] + z.sum())
        row, col = np.repeat(np.arange(len(r)), z), k + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
        wide = (len(r), k + int(z.max()))
        i, s, f = np.full(wide, -1, np.int32), np.full(wide, -9, np.float32), np.ones(wide, bool)
        i[:, :k], s[:, :k], f[:, :k] = others[r], sims[r], new[r]
        i[row, col], s[row, col] = other[here], sim[here]
        others[r], sims[r], new[r] = _best(i, s, f, k)


def _members(others: np.ndarray, new: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """At each node a sample of its new entries, of those that have it as a new one, and both of old ones: size columns each, -1 for none.

    A node that very many have as a neighbour hears of as few of them as any
    other. New entries that are taken are old ones from now on.
    """
    n = len(others)
    out, mark = np.full((n, 4 * size), -1, np.int32), rng.random(others.shape, np.float32)
    was = new.copy()
    for j, kind in enumerate((was, ~was & (others >= 0))):
        at = np.argpartition(np.where(kind, mark, 2), size - 1, 1)[:, :size]
        taken = np.where(np.take_along_axis(kind, at, 1), np.take_along_axis(others, at, 1), -1)
        out[:, 2 * j * size : (2 * j + 1) * size] = taken
        row, col = np.nonzero(taken >= 0)
        if not j:
            new[row, at[row, col]] = False
        deal = rng.permutation(len(row))
        out[taken[row, col][deal], (2 * j + 1) * size + rng.integers(0, size, len(row))] = row[deal]
    return out


def _descended(x: np.ndarray, others: np.ndarray, sims: np.ndarray, stable: float, rng: np.random.Generator) -> np.ndarray:
    """The lists after descent. An entry gives way only to a better one, so rounds change less and less."""
    n, k = others.shape
    size, new = min(SAMPLE, k), others >= 0
    half, changed = 2 * size, 1.0
    while changed >= stable:
        members = _members(others, new, size, rng)
        left, least, found, held = int(new.sum()), sims[:, -1].copy(), [], 0
        for lo in range(0, n, 1024):
            m = members[lo : lo + 1024]
            some, at = m >= 0, np.maximum(m, 0)
            y = x[at]
            sim = np.matmul(y[:, :half], y.transpose(0, 2, 1))
            worst = np.where(some, least[at], 9).astype(np.float32)
            sim[m[:, :half, None] == m[:, None, :]] = -9
            there = (sim > worst[:, :half, None]) & some[:, None, :]
            back = (sim > worst[:, None, :]) & some[:, :half, None]
            back[:, :, :half] = False  # pairs of new ones come up in both orders
            for good, to, other in ((there, 1, 2), (back, 2, 1)):
                where = np.nonzero(good)
                found.append((m[where[0], where[to]], m[where[0], where[other]], sim[where]))
                held += len(where[0])
            if found and (held > HELD or lo + 1024 >= n):
                _offered(others, sims, new, *(np.concatenate(v) for v in zip(*found, strict=True)))
                least, found, held = sims[:, -1].copy(), [], 0
        changed = (int(new.sum()) - left) / max(1, int((others >= 0).sum()))
    return others


def graph_of(x: np.ndarray, k: int = K, stable: float = STABLE) -> np.ndarray:
    """(n, 2 * k) positions that each vector is linked to, -1 for none: its neighbours, and some that have it as one."""
    n, rng = len(x), np.random.default_rng(11)
    k = min(k, n - 1)
    if not k:
        return np.full((n, 1), -1, np.int32)
    others = _descended(x, *_leaves(x, k, rng), stable, rng)
    links = np.append(others, np.full((n, k), -1, np.int32), 1)
    row, col = np.nonzero(others >= 0)
    deal = rng.permutation(len(row))
    links[others[row, col][deal], k + rng.integers(0, k, len(row))] = row[deal]
    return links


def _graph(table: pa.Table) -> pa.Table:
    """A block's graph, in rows of ROW nodes."""
    table = table.sort_by("node").combine_chunks()
    node, units = table.column("node").to_numpy(), table.column("unit").to_pylist()
    links = graph_of(_matrix(units))
    at = range(0, len(node), ROW)
    kept = {"nodes": [node[i : i + ROW].tobytes() for i in at], "units": [b"".join(units[i : i + ROW]) for i in at], "links": [links[i : i + ROW].tobytes() for i in at]}
    return pa.table({"block": pa.array([table.column("block")[0].as_py()] * len(at), pa.int32()), "row": pa.array(range(len(at)), pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in kept.items()})


def build_graph(units: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(block, row, nodes, units, links) over units (node, unit, dim): each block's graph, as bytes; links are positions in the order of rows and nodes."""
    placed = units.mapInArrow(_placed(cells), "block int, node bigint, unit binary")
    return stored(placed.groupBy("block").applyInArrow(_graph, _GRAPH), "near-graph")


# Search


class _Seen:
    """What is told apart by walks side by side: the latest turn in which one of them met a node."""

    def __init__(self, n: int):
        self.turns, self.next = np.full(ABREAST * n, -1, np.int32), 0

    def begin(self) -> int:
        """The first turn of new walks."""
        if self.next > 1 << 30:
            self.turns[:], self.next = -1, 0
        return self.next

    def once(self, key: np.ndarray, first: int) -> np.ndarray:
        """Where keys are that no turn since first has met, each once."""
        at = np.flatnonzero(self.turns.take(key) < first)
        key = key[at]
        turn = np.arange(self.next, self.next + len(at), dtype=np.int32)
        self.next += len(at)
        self.turns[key] = turn
        return at[self.turns.take(key) == turn]


def _walk(x: np.ndarray, links: np.ndarray, queries: np.ndarray, ef: int, step: int, seen: _Seen) -> tuple[np.ndarray, np.ndarray]:
    """The ef best positions that a greedy walk finds for each of ABREAST queries or fewer, and their sims; -1 and -9 for none."""
    n, live, first = len(x), np.arange(len(queries)), seen.begin()
    ids, sims, done = np.full((len(live), ef), -1, np.int32), np.full((len(live), ef), -9, np.float32), np.ones((len(live), ef), bool)
    entries = np.arange(0, n, ENTRY if n > ENTRY * BEGUN else max(1, n // BEGUN), dtype=np.int32)
    m = min(BEGUN, len(entries))
    met = entries[np.argpartition(-(queries @ x[entries].T), m - 1, 1)[:, :m]]
    while True:
        flat, at = met.ravel(), np.flatnonzero(met.ravel() >= 0)
        at = at[seen.once((met + live[:, None] * n).ravel()[at], first)]
        row, other = at // met.shape[1], flat.take(at)
        sim, bounds = np.empty(len(at), np.float32), np.searchsorted(row, np.arange(len(live) + 1))
        for i, q in enumerate(live):
            here = slice(bounds[i], bounds[i + 1])
            sim[here] = x.take(other[here], 0) @ queries[q]
        good = np.flatnonzero(sim > sims[live, -1][row])
        row, other, sim = row[good], other[good], sim[good]
        size = np.bincount(row, minlength=len(live))
        wide, col = (len(live), ef + int(size.max())), ef + np.arange(len(row)) - (np.cumsum(size) - size)[row]
        i, s, d = np.full(wide, -1, np.int32), np.full(wide, -9, np.float32), np.ones(wide, bool)
        i[:, :ef], s[:, :ef], d[:, :ef] = ids[live], sims[live], done[live]
        i[row, col], s[row, col], d[row, col] = other, sim, False
        order = np.argsort(-s, 1, kind="stable")[:, :ef]
        i, s, d = (np.take_along_axis(v, order, 1) for v in (i, s, d))
        open_ = ~d & (np.cumsum(~d, 1, dtype=np.int32) <= step)
        ids[live], sims[live], done[live] = i, s, d | open_
        count = open_.sum(1)
        going = count > 0
        live, count = live[going], count[going]
        if not len(live):
            return ids, sims
        row, col = np.nonzero(open_[going])
        nodes = np.full((len(live), int(count.max())), -1, np.int32)
        nodes[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = i[going][row, col]
        met = links.take(np.maximum(nodes, 0), 0)
        met[nodes < 0] = -1
        met = met.reshape(len(live), -1)


def _walked(top: int, step: int):
    """For a block's queries what walks of its graph find and what can be among the top, without the query itself."""

    def run(graph: pa.Table, asks: pa.Table) -> pa.Table:
        out = {"q": [], "sizes": [], "others": [], "sims": []}
        if len(graph) and len(asks):
            graph = graph.sort_by("row")
            joined = lambda c, kind: np.frombuffer(b"".join(graph.column(c).to_pylist()), kind)
            node = joined("nodes", np.int64)
            x, links = joined("units", np.float16).reshape(len(node), -1).astype(np.float32), joined("links", np.int32).reshape(len(node), -1)
            q, held, units = asks.column("q").to_numpy(), asks.column("ef").to_numpy(), asks.column("query").to_pylist()
            order, seen = np.lexsort((q, held)), _Seen(len(node))
            for ef in np.unique(held):
                mine = order[held[order] == ef]
                abreast = max(1, min(ABREAST, (1 << 22) // int(ef)))
                for lo in range(0, len(mine), abreast):
                    at = mine[lo : lo + abreast]
                    ids, sims = _walk(x, links, _matrix([units[i] for i in at]), min(int(ef), len(node)), min(step, int(ef)), seen)
                    others = node[np.maximum(ids, 0)]
                    sims[others == q[at][:, None]] = -9
                    last = -np.partition(-sims, min(top, sims.shape[1]) - 1, 1)[:, min(top, sims.shape[1]) - 1] - COARSE
                    good = (sims >= last[:, None]) & (sims > -5)
                    for c, v in (("q", q[at]), ("sizes", good.sum(1)), ("others", others[good]), ("sims", sims[good])):
                        out[c].append(v)
        each = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}
        return pa.table({"q": pa.array(each["q"], pa.int64()), "others": _lists(each["sizes"], pa.array(each["others"], pa.int64())), "sims": _lists(each["sizes"], pa.array(each["sims"], pa.float32()))})

    return run


def search(graph: DataFrame, asking: DataFrame, cells: dict[int, Cells], share: float, top: int, ef: int = EF, step: int = STEP) -> DataFrame:
    """(q, list): for each of asking (node, unit, dim) what walks find and what can be among the top, an array of (sims, others), best first."""
    asks = stored(asking.mapInArrow(_asks(cells, share, ef, min(ef, max(top + 1, BEGUN))), "block int, q bigint, query binary, ef int"), "near-asks")
    parts = [(r.block, ceil(r["count"] / ASKS)) for r in asks.groupBy("block").count().collect()]
    if not parts:
        return asks.select("q", F.array().cast("array<struct<sims:float,others:bigint>>").alias("list"))
    tasks = F.broadcast(asks.sparkSession.createDataFrame(parts, "block int, parts int"))
    asks = asks.join(tasks, "block").select("block", F.pmod(F.xxhash64(F.lit(23), "q"), F.col("parts")).cast("int").alias("part"), "q", "query", "ef")
    walked = graph.join(tasks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row", "nodes", "units", "links")
    found = walked.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInArrow(_walked(top, step), _FOUND)
    listed = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("sims", "others"))), asc=False)
    return found.groupBy("q").agg(listed.alias("list"))


def exact(units: DataFrame, queries: list, cells: dict[int, Cells], top: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Each query's top sims, by comparing it with all units of its dimension, and the share of cells that reaches each of them; queries (node, unit, dim) are few."""
    mine = {d: ([r.node for r in queries if r.dim == d], _matrix([r.unit for r in queries if r.dim == d])) for d in {r.dim for r in queries}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c, node, x in _by_cells(batches, cells, 2048):
            d = x.shape[1]
            if d in mine:
                ids, asked = mine[d]
                sim, cell = asked @ x.T, np.broadcast_to((x @ c.centers.T).argmax(1).astype(np.int32), (len(ids), len(x)))
                sim[np.array(ids)[:, None] == node] = -9
                if d in best:
                    sim, cell = np.append(best[d][0], sim, 1), np.append(best[d][1], cell, 1)
                at = np.argpartition(-sim, min(top, sim.shape[1]) - 1, 1)[:, :top]
                best[d] = np.take_along_axis(sim, at, 1), np.take_along_axis(cell, at, 1)
        for d, (sim, cell) in best.items():
            yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(mine[d][0], sim.shape[1]), pa.int64()), "sim": pa.array(sim.ravel(), pa.float32()), "cell": pa.array(cell.ravel(), pa.int32())})

    found: dict[int, list] = {}
    for r in units.mapInArrow(run, "q bigint, sim float, cell int").collect():
        found.setdefault(r.q, []).append((r.sim, r.cell))
    out = {}
    for d, (ids, asked) in mine.items():
        rank = np.argsort(np.argsort(-(asked @ cells[d].centers.T), 1), 1)
        for i, q in enumerate(ids):
            near = [p for p in sorted(found.get(q, []), reverse=True)[:top] if p[0] > -5]
            if near:
                out[q] = np.array([s for s, _ in near]), (rank[i][[c for _, c in near]] + 1) / len(cells[d].centers)
    return out


def far_enough(units: DataFrame, graph: DataFrame, asking: DataFrame, cells: dict[int, Cells], largest: int, top: int, ef: int = EF) -> tuple[int, float, float]:
    """ef, doubled, and the share of cells, raised, until walks find SAFE of the top that brute force finds for TRIED of asking; and the recall there.

    At last a walk holds all of a block, and all cells are walked. A walk's
    find counts as right if it's at least as near as the last of the top.
    """
    tried = stored(asking.orderBy(F.xxhash64(F.lit(5), "node")).limit(TRIED), "near-tried")
    want = exact(units, tried.collect(), cells, top)
    if not want:
        return ef, 1.0, 1.0
    reach = np.sort(np.concatenate([shares for _, shares in want.values()]))
    share = float(reach[ceil((1 + SAFE) / 2 * len(reach)) - 1])
    most = largest * max(len(c.centers) for c in cells.values())
    while True:
        got = search(graph, tried, cells, share, top, ef).collect()
        sweep(units.sparkSession)  # a graph's shuffle files
        hits = sum(min(len(want[r.q][0]), sum(e.sims >= want[r.q][0][-1] - 1e-6 for e in r["list"])) for r in got if r.q in want)
        recall = hits / len(reach)
        if recall >= SAFE or (ef >= most and share >= 1):
            return ef, share, recall
        ef, share = ef * 2, 1.0 if ef >= largest else min(1.0, share * 1.1)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.small(batches, 4096):
        x, y = (batch.column(c).to_pylist() for c in "xy")
        score = np.zeros(len(x))
        for at in _by_dim(np.array([len(v) for v in x])):
            a, b = _scaled([x[i] for i in at]), _scaled([y[i] for i in at])
            score[at] = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        yield T.with_columns(batch.drop_columns(["x", "y"]), {"score": pa.array(score)})


def nearest(vectors: DataFrame, asked: Column, top: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", ef: int = EF) -> DataFrame:
    """(query_id, rank, vec_id, score): the top nearest that are found for each vector whose id meets asked.

    asked is a condition on a column id. Nearness is the cosine in double
    precision, equal ones by the smaller id. Defined cases: what takes part is
    said at usable(); a query that takes no part has no rows; each of different
    vectors with one id is a query of its own, and a candidate of the others;
    only vectors of the query's dimension are candidates; with fewer than top
    of them all are returned; an empty table gives an empty one.
    """
    rows = stored(usable(vectors, vec_id, embedding), "near-vectors")
    nodes, queries = stored(nodes_of(rows, top + 1), "near-nodes"), stored(rows.filter(asked), "near-queries")
    release(rows)
    units = stored(nodes.select("node", "vec").mapInArrow(_units, "node bigint, unit binary, dim int"), "near-units")
    asking = queries.groupBy("vec").agg(F.count(F.lit(1)).alias("copies")).join(nodes.select("node", "vec"), "vec").select("node", "copies", F.col("vec").alias("__vec"))
    asking = stored(asking, "near-asking")
    walking = stored(units.join(asking.select("node"), "node", "left_semi"), "near-walking")
    cells, largest = cells_of(units)
    sweep(units.sparkSession)
    graph = build_graph(units, cells)
    sweep(units.sparkSession)
    ef, share, _ = far_enough(units, graph, walking, cells, largest, top, ef)
    release(units)
    state = stored(search(graph, walking, cells, share, top, ef), "near-found")
    release(graph)
    # What can be among the top by the vectors themselves, and the node's own copies.
    last = F.coalesce(F.get("list", F.lit(top - 1))["sims"], F.lit(-2.0)) - F.lit(COARSE)
    near = F.transform(F.filter("list", lambda e: e["sims"] >= last), lambda e: e["others"])
    pairs = state.select("q", F.explode(near).alias("other")).union(asking.select("node", F.col("node")))
    x = asking.select(F.col("node").alias("q"), F.col("__vec").alias("x"))
    y = nodes.select(F.col("node").alias("other"), F.col("vec").alias("y"), "ids")
    scored = pairs.join(y, "other").join(x, "q").select("q", "other", "ids", "x", "y").mapInArrow(_cosines, "q bigint, other bigint, ids array<bigint>, score double")
    each = scored.select("q", "score", (F.col("q") == F.col("other")).alias("own"), F.explode("ids").alias("id"))
    listed = F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("id")).alias("minus"), "own")), asc=False), 1, top + 1)
    best = each.groupBy("q").agg(listed.alias("list")).join(asking, F.col("q") == F.col("node")).select("__vec", "copies", "list")
    found = answered(queries, stored(best, "near-best"), {"vec": "__vec"}, how="inner")
    others = F.slice(F.filter("list", lambda e: ~(e["own"] & (e["minus"] == -F.col("id")))), 1, top)
    ranked = found.select("id", F.posexplode(others).alias("at", "x"))
    return ranked.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.minus")).alias("vec_id"), F.col("x.score").alias("score"))


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
