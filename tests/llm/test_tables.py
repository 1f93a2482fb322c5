"""Operators over whole tables, against brute force."""

import hashlib

import brute
import numpy as np
import pytest
from conftest import alike_to_a_polynomial, sf
from pyspark.sql import functions as F

from sievework.llm import components, mixing, near_dedup, neighbours, repeats
from sievework.llm._store import stored

# Mixing


def fill(totals, weights, ratio, epochs):
    """Water-filling in a loop."""
    budget, left, out = ratio * sum(totals), set(range(len(totals))), [0.0] * len(totals)
    while left:
        share = {i: budget * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if share[i] >= epochs * totals[i]}
        if not over:
            for i in left:
                out[i] = share[i]
            break
        for i in over:
            out[i] = epochs * totals[i]
        budget -= sum(out[i] for i in over)
        left -= over
    return out


def test_targets_against_a_loop(spark):
    r = np.random.default_rng(3)
    for n in (1, 2, 5, 20):
        totals = r.integers(0, 1000, n).tolist()
        stats = spark.createDataFrame([(f"s{i:03}", t, 3) for i, t in enumerate(totals)], "__source string, __total bigint, __n bigint")
        got = {x["__source"]: x["__target"] for x in mixing.targets(stats, (5, 2, 1), 1.5, 2.0).collect()}
        want = fill(totals, [(5, 2, 1)[i % 3] for i in range(n)], 1.5, 2.0)
        assert [got[f"s{i:03}"] for i in range(n)] == pytest.approx(want)


def test_mix_meets_its_targets_and_repeats_itself(spark):
    d = sf("0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = mixing.op1_mix_sources(spark, d).join(docs.select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max(F.col("taken") / F.col("size")).alias("m")).collect():
        assert abs(r.k - r.t) < 0.02 * r.t and r.m <= 2
    again = mixing.op1_mix_sources(spark, d)
    assert again.exceptAll(mixing.op1_mix_sources(spark, d)).count() == 0
    mixed = mixing.repeated(mixing.mix(docs))
    assert mixed.columns == docs.columns and mixed.count() == mixing.mix(docs).agg(F.sum("mix_copies")).first()[0]


def test_mix_of_odd_tables(spark, docs, crowded, empty):
    rows = mixing.mix(docs, {"src1": 3.0, None: 1.0}).collect()
    assert len(rows) == docs.count() and all(r.mix_copies == 0 for r in rows if r.source not in ("src1", None))
    assert all(r.mix_size == len(brute.words(r.text)) for r in rows)
    assert mixing.mix(crowded).count() == docs.count() and mixing.mix(empty).count() == 0
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Near copies


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.sort(pool[:300]), np.sort(pool[50:350]), pool[:1], np.zeros(0, np.uint64)]
    bounds = np.append(0, np.cumsum([len(s) for s in sets]))
    out = near_dedup.sketches(np.concatenate(sets), bounds, 512)
    assert (out[:3] != near_dedup._FULL).all() and (out[3] == near_dedup._FULL).all()
    assert abs((out[0] == out[1]).mean() - 250 / 350) < 0.08


def near(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect() if r["doc_id"] is not None}


def test_near_copies_against_all_pairs(spark):
    d = sf("0.01")
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert near(near_dedup.op4_near_duplicates(spark, d)) == brute.near(texts)


def test_chains_and_groups_of_near_copies(spark):
    r = np.random.default_rng(5)
    base, texts = [f"v{i}" for i in r.integers(0, 5000, 150)], []
    for _ in range(150):  # copies with one to four words changed: some linked, some only alike
        w = list(base)
        for at in r.choice(150, r.integers(1, 5), replace=False):
            w[at] = f"x{r.integers(0, 10**6)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):  # each alike to the next one only
        texts.append(" ".join([*chain[step * 5 :], *(f"d{step}_{i}" for i in range(step))]))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (80, 85):
        assert near(near_dedup.near_duplicates(docs, percent)) == brute.near(rows, percent)


def test_texts_that_polynomials_take_for_equal_are_not_linked(spark):
    rows = list(enumerate([*alike_to_a_polynomial("words"), *alike_to_a_polynomial(), *alike_to_a_polynomial("words")[:1]]))
    got = near(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == brute.near(rows) and got[1][1] == 1 and got[4][1] == 0


def test_sets_that_can_not_be_linked_leave_their_buckets(spark, monkeypatch):
    """2,000 sets, half of each common to all: thousands share a bucket, and none is compared."""
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *(f"o{i}x{j}" for j in range(60))])) for i in range(2000)]
    asked, real = [], near_dedup.confirmed

    def counted(pairs, sets, percent):
        asked.append(pairs.count())
        return real(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    shared = near_dedup.classes_of(near_dedup.signatures(docs)).select(F.explode("bands").alias("band")).groupBy("band").count().agg(F.max("count")).first()[0]
    assert near(near_dedup.near_duplicates(docs)) == {i: (116, i, True) for i, _ in rows}
    assert shared > 20 and sum(asked) < 2000


def test_near_copies_in_odd_tables(spark, docs, rows, crowded, empty):
    got = near(near_dedup.near_duplicates(docs))
    want = brute.near([(r[0], r[1]) for r in rows if r[0] is not None and r != rows[6]] + [(rows[6][0], rows[6][1])])
    assert got == want
    lost = [r for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is None]
    assert len(lost) == 2 and all(r.kept and r.component_id is None for r in lost)
    assert near(near_dedup.near_duplicates(crowded)) == want and near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.deduplicated(docs, 85)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, x in want.items() if x[2]) and ids.count(None) == 2


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.cls: r.comp for r in components.components(df).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)}


# Repeated passages


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_repeats_against_counting(spark, group):
    d = sf("0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    want = brute.repeats([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.without_repeats(docs, group=group).collect()}
    assert got == want


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_repeats_in_odd_texts(spark, group):
    r = np.random.default_rng(2)
    word = lambda n: "".join(r.choice(list("abcdé"), n))
    passage, periodic = word(260), "xyz " * 200
    texts = [None, "", "short", periodic, word(50) + passage, passage + word(50), word(30) + passage[:199] + word(300), word(120) + passage + word(90) + passage[20:240], "a" * 500, word(5000)]
    for _ in range(12):
        at = int(r.integers(0, 250))
        texts.append(word(40) + passage[:at] + word(1) + passage[at + 1 :] + word(40))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: tuple(x)[1:5] for x in repeats.without_repeats(docs, group=group).collect()}
    assert got == brute.repeats(rows)


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_texts_that_polynomials_take_for_equal_are_no_repeats(spark, group):
    a, b = alike_to_a_polynomial()
    rows = list(enumerate([a, b, "x" + a[:300], b[300:700] + "y", a]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: tuple(x)[1:5] for x in repeats.without_repeats(docs, group=group).collect()}
    assert got == brute.repeats(rows) and got[1][1] == 400


def test_large_groups_are_dealt_out_until_they_fit(spark):
    """One passage in 60 contexts that all differ: the expansion decides them in groups of 4 at most."""
    r = np.random.default_rng(8)
    word = lambda n: "".join(r.choice(list("abcdefgh"), n))
    passage = word(230)
    rows = [(i, word(100) + passage[: 205 + i % 20] + word(150)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: tuple(x)[1:5] for x in repeats.without_repeats(docs, group=4).collect()}
    assert got == brute.repeats(rows) and all(x[1] >= 205 for x in got.values())


def test_repeats_in_odd_tables(spark, docs, crowded, empty):
    rows = repeats.without_repeats(docs).collect()
    assert len(rows) == docs.count() and repeats.without_repeats(crowded).count() == docs.count() and repeats.without_repeats(empty).count() == 0
    got = {r.doc_id: r for r in rows}
    assert got[4].n_removed == got[4].n_bytes == got[5].n_removed and got[0].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_suffixes_and_boundaries_against_sorting():
    r = np.random.default_rng(0)
    parts = ["".join(r.choice(list("ab"), n)).encode() for n in (40, 17, 40, 3)]
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    symbols[ends] = 0
    left = ends[np.repeat(np.arange(4), [len(p) + 1 for p in parts])] - np.arange(len(symbols))
    order, place = repeats.suffix_order(symbols, left, 8)
    text = lambda i: bytes((symbols[i : i + left[i]] - 1).astype(np.uint8))
    assert [text(i)[:8] for i in order] == sorted(text(i)[:8] for i in range(len(symbols)))
    cut = repeats.boundaries(symbols, order, place, 8)
    whole = [i for i in order if left[i] >= 8]
    group = np.cumsum(cut)[place]
    for a in whole:
        for b in whole:
            assert (text(a)[:8] == text(b)[:8]) == (group[a] == group[b])


# Nearest neighbours


def recall(vectors, found, asked, top=5):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q in asked:
        s = x @ x[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        best = set(ids[np.lexsort((ids, -s))[:top]].tolist())
        hits.append(len(best & set(found.get(q, []))) / len(best))
    return float(np.mean(hits))


def test_recall_and_scores(spark):
    d = sf("0.1")
    rows = neighbours.op9_nearest_neighbours(spark, d).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    found, asked = {}, [i for i in vectors if i % 50 == 0]
    for r in rows:
        found.setdefault(r.query_id, []).append(r.vec_id)
        a, b = np.array(vectors[r.query_id], float), np.array(vectors[r.vec_id], float)
        assert r.score == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)
    assert recall(vectors, found, asked) >= 0.9
    for q in asked:
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_search_is_widened_until_recall_is_safe(spark):
    x = np.random.default_rng(6).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = {}
    for r in neighbours.nearest(df, F.col("id") % 25 == 0, ef=6).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert recall(dict(enumerate(x)), found, range(0, 3000, 25)) >= 0.93


def shuffled(spark) -> int:
    """Bytes that all stages so far have shuffled."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_vectors_travel_a_few_times_only(spark):
    """A round of descent by joins sends each vector to all whose neighbours it may be: some 50 KB for each vector of 64 components."""
    n = 12_000
    x = np.random.default_rng(7).normal(size=(n, 64))
    df = stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"), "test")
    before, found = shuffled(spark), {}
    for r in neighbours.nearest(df, F.col("id") % 50 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert 256 * n < shuffled(spark) - before < 4096 * n
    assert recall(dict(enumerate(x)), found, range(0, n, 50)) >= 0.93


def test_blocks_are_bounded_and_hold_all(spark, monkeypatch):
    """Vectors that lie close together are cut into blocks too, and a query walks all parts of its cell."""
    monkeypatch.setattr(neighbours, "BLOCK", 600)
    monkeypatch.setattr(neighbours, "LEAST", 600)
    monkeypatch.setattr(neighbours, "ASKS", 40)
    x = np.random.default_rng(8).normal(size=(4000, 16))
    x[:3000] = x[0] + 0.3 * x[:3000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    units = stored(df.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec")).mapInArrow(neighbours._units, "node bigint, unit binary, dim int"), "test")
    cells, largest = neighbours.cells_of(units)
    graph = neighbours.build_graph(units, cells).collect()
    sizes = {}
    for r in graph:
        sizes[r.block] = sizes.get(r.block, 0) + len(r.nodes) // 8
    assert sum(sizes.values()) == 4000 and max(sizes.values()) <= 1200 and largest <= 1200
    assert sorted(i for r in graph for i in np.frombuffer(bytes(r.nodes), np.int64)) == list(range(4000))
    found = {}
    for r in neighbours.nearest(df, F.col("id") % 40 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 4000, 40)) and recall(dict(enumerate(x)), found, found) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, []), (1, [2.0, 0.0]), (10, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"id": F.lit(1), "vec": F.lit(2), "center": F.lit(3)})
    got = [tuple(r) for r in neighbours.nearest(df, F.col("id") >= 0).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 10), (0, 3, 2)] and {g[0] for g in got} == {0, 1, 2, 10}
    assert neighbours.nearest(df.limit(0), F.col("id") >= 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), F.col("id") >= 0).count() == 0


def test_vectors_of_any_scale_and_dimension(spark):
    """Squares that overflow or vanish, ids that repeat with other vectors, dimensions of their own, and a vector with very many rows."""
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, 3e-200]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 2.0, 0.0]), (6, [1e308, 1e308]), (2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("id") >= 0).collect())
    half = 2**-0.5
    # Of id 2 there are two rows: each is a query of its own, and a candidate of the other.
    want = [(0, 1, half), (0, 2, half), (0, 2, 1.0), (0, 3, 0.0), (0, 6, half), (1, 0, half), (1, 2, half), (1, 2, 1.0), (1, 3, half), (1, 6, 1.0), (4, 5, half), (5, 4, half)]
    assert [x for x in got if x[0] in (0, 1, 4, 5)] == [(q, i, pytest.approx(x)) for q, i, x in want]
    assert [x[2] for x in got if x[:2] == (2, 2)] == [pytest.approx(half)] * 2 and not any(np.isnan(x[2]) for x in got)
    same = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.rand(3), F.rand(4))).alias("embedding"))
    found = neighbours.nearest(same, F.col("id") % 50 == 0).collect()
    for q in range(0, 3000, 150):
        mine = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: (r.query_id, r["rank"])) if r.query_id == q]
        assert [i for i, _ in mine] == [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5] and all(x == pytest.approx(1.0) for _, x in mine)


# Tables between steps, and the pipeline


def test_answers_of_hot_keys_are_dealt_out(spark):
    from sievework.llm._join import HOT, answered

    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    answers = rows.filter("k is not null").groupBy(F.col("k").alias("name")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    got = answered(rows, answers, {"k": "name"}).collect()
    assert len(got) == 6000 and all(r.least == (None if r.k is None else 0 if r.k == "hot" else r.id) for r in got)
    assert answered(rows, answers, {"k": "name"}, how="inner").count() == 4000
    assert answered(rows, answers.limit(0), {"k": "name"}).count() == 6000 and HOT < 2000


def test_stored_tables_keep_rows_and_types(spark, docs):
    back = stored(docs, "test")
    assert back.schema == docs.schema and back.count() == docs.count() and back.stored_at.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    from sievework.llm import mixing, pii, subword

    d = sf("0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out, tables = docs, {}
    for name, stage in p.STAGES:
        out = stored(stage(spark, out, d), f"test-{name}")
        tables[name] = out
    assert [n for n, _ in p.STAGES] == ["toxicity", "minhash", "pii", "mixing", "sentencepiece"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.toxic}
    one = {r.doc_id for r in tables["toxicity"].collect()}
    clean = set(texts) - {i for i, t in texts.items() if any(w in t.lower() for w in ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "loser", "disgusting", "trash", "clown"))}
    assert clean - toxic <= one
    want = brute.near([(i, texts[i]) for i in one], 80)
    two = {r.doc_id for r in tables["minhash"].collect()}
    assert two == {i for i, x in want.items() if x[2]}
    three = {r.doc_id: r.text for r in tables["pii"].collect()}
    assert set(three) == two and all(not pii.base_spans(t)[0] for t in three.values())
    pieces = subword.load()
    mixed = sorted((r.doc_id, r.text) for r in tables["mixing"].collect())
    assert set(mixed) <= {(i, t) for i, t in three.items()}
    assert sorted((r.doc_id, subword.decode(r.ids, pieces)) for r in tables["sentencepiece"].collect()) == mixed
    assert all(t.columns == list(p.COLUMNS) for n, t in tables.items() if n != "sentencepiece")
    assert p.run(spark, d).count() == len(mixed) and mixing.mix(tables["pii"]).count() == len(three)
