"""Operators on one text at a time, against plain versions and held-out labels."""

import hashlib
import tarfile
import zlib
from pathlib import Path

import numpy as np
import pytest
from conftest import alike_to_a_polynomial, sf
from pyspark.sql import functions as F
from test_tables import shuffled

from sievework.llm import _text as T
from sievework.llm import lm_scoring, media, pii, quality, subword, toxicity
from sievework.llm._labels import remainder


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_and_hashes_of_a_block():
    texts = ["a  B\tc", "", "\n", "B c", "é x"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    start, end, first = T.words(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(start, end, strict=True)] == [b"a", b"B", b"c", b"B", b"c", "é".encode(), b"x"] and first.tolist() == [0, 3, 3, 3, 5, 7]
    h = T.span_hash(data, start, end)
    assert h[1] == h[3] and h[2] == h[4] and len(set(h.tolist())) == 5
    assert [b[:2] for b in T.blocks(data, offsets, 6)] == [(0, 2), (2, 4), (4, 5)]


# Toxicity


def test_transducers_read_a_clause():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {"moro": 1.0})
    way = lambda text: dict(zip(toxicity.WAYS, toxicity.events(text, lexicon), strict=True))
    assert way("what an idiot") == {"plain": 2.0, "targeted": 0, "negated": 0, "reported": 0, "threat": 0}
    assert way("you are an idiot")["targeted"] == 2.0 and way("idiot, you")["targeted"] == 2.0
    assert way("you are not an idiot")["negated"] == 2.0 and way("not here today in this place idiot")["plain"] == 2.0
    assert way("they said idiot")["reported"] == 2.0 and way('the word "idiot" is short')["reported"] == 2.0
    assert way("they said so. idiot")["plain"] == 2.0
    assert way("I will kill you")["threat"] == 4.0 and way("I kill time")["threat"] == 0
    assert way("morons everywhere")["plain"] == 1.0 and way("") == way("fine") == dict.fromkeys(toxicity.WAYS, 0.0)


def test_toxicity_held_out(spark):
    d = sf("0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.op2_toxicity(spark, d).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.toxic for r in rows)) > 0.9 and hit / max(1, sum(r.predicted for r in rows)) > 0.95


def test_toxicity_learns_from_no_held_out_label(spark, docs, labels):
    flipped = labels.withColumn("toxic", F.when(remainder(F.col("doc_id"), 4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit_toxicity(docs, x) for x in (labels, flipped))
    assert one.intercept == two.intercept and (one.weights == two.weights).all() and one.lexicon.whole == two.lexicon.whole


def test_op2_query_against_looking_around_each_word(spark):
    import brute

    d = sf("0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = toxicity.op2_toxicity(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = model.intercept + sum(w * np.log1p(e) for w, e in zip(model.weights, brute.toxic_events(texts[r.doc_id], model.lexicon, toxicity), strict=True))
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(x, -30, 30)))) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_grammar_against_looking_around_each_word():
    import random

    import brute

    r = random.Random(6)
    lexicon = toxicity.Lexicon({"idiot": 2.0}, {"moro": 1.0}, {"stup": 3.0})
    words = ["idiot", "morons", "stupor", "will", "gonna", "kill", "hurt", "you", "them", "not", "never", "said", "wrote", '"', "a", "the", ".", "Idiot,"]
    for _ in range(4000):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 14)))
        assert toxicity.events(text, lexicon).tolist() == brute.toxic_events(text, lexicon, toxicity), text


# Quality


def test_op7_query_against_plain_features(spark):
    from bisect import bisect_right

    import brute

    d = sf("0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.op7_quality(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = brute.quality_features(texts[r.doc_id])
        fine, wide = ([bisect_right(list(e), v) for e, v in zip(edges, x, strict=True)] for edges in (model.edges, model.coarse))
        odds = model.base + sum(t[k] for t, k in zip(model.tables, fine, strict=True)) + sum(t[wide[i], wide[j]] for (i, j), t in model.pairs.items())
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(odds, -30, 30)))) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_lookup_tables_learn_a_pair():
    r = np.random.default_rng(0)
    x = r.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.9 and (1, 0) in model.pairs


def test_quality_held_out(spark):
    d = sf("0.1")
    rows = quality.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_features_of_empty_texts_are_zero():
    assert not quality.features(np.zeros(0, np.uint8), np.array([0, 0, 0])).any()


# Cross-entropy difference


def test_losses_against_a_plain_version(spark):
    texts = [(0, "a b a b"), (1, "a b c"), (2, "c c c c"), (3, None), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    vocabulary, target, background = lm_scoring.fit_models(lm_scoring.marked(docs, spark.createDataFrame([(0,), (1,), (None,)], "doc_id int")))
    assert len(vocabulary.words) == 3
    got = by_id(lm_scoring.score_lm(docs, vocabulary, target, background), "n_tokens", "target_loss", "background_loss", "lm_score")

    def plain(text, corpus):
        from collections import Counter

        one, two, first = Counter(), Counter(), Counter()
        for t in corpus:
            w = t.split()
            one.update(w)
            first.update(["<s>", *w[:-1]])
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
        n, loss = sum(one.values()), []
        for a, b in zip(["<s>", *text.split()[:-1]], text.split(), strict=True):
            single = (one[b] + 0.5) / (n + 0.5 * 5)
            loss.append(-np.log2((two[a, b] + lm_scoring.MASS * single) / (first[a] + lm_scoring.MASS)))
        return np.mean(loss)

    for i in (0, 1, 2):
        t, b = plain(texts[i][1], ["a b a b", "a b c"]), plain(texts[i][1], ["a b a b", "a b c", "c c c c"])
        assert got[i] == (len(texts[i][1].split()), pytest.approx(t), pytest.approx(b), pytest.approx(t - b))
    assert got[3] == got[4] == (0, None, None, None)


def test_models_grow_with_the_corpus(spark):
    """More different words and pairs than any fixed table of 2^15 words and 2^19 cells holds apart: every count is exact."""
    from collections import Counter

    r = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{x}" for x in (r.random(4000) ** 2 * 90_000).astype(int)), i % 2) for i in range(200)]
    rows = spark.createDataFrame(texts, "doc_id int, text string, target int").repartition(3)
    got = by_id(lm_scoring.score_corpus(rows, rows), "n_tokens", "target_loss", "background_loss")
    for place, corpus in ((1, [t for _, t, m in texts if m]), (2, [t for _, t, _ in texts])):
        one, two, first = Counter(), Counter(), Counter()
        for t in corpus:
            w = t.split()
            one.update(w)
            first.update(["<s>", *w[:-1]])
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
        n, size = sum(one.values()), len({w for _, t, _ in texts for w in t.split()})
        assert size > 1 << 15
        for i, t, _ in texts[:8]:
            pairs = zip(["<s>", *t.split()[:-1]], t.split(), strict=True)
            want = np.mean([-np.log2((two[a, b] + lm_scoring.MASS * (one[b] + 0.5) / (n + 0.5 * (size + 2))) / (first[a] + lm_scoring.MASS)) for a, b in pairs])
            assert got[i][0] == 4000 and got[i][place] == pytest.approx(want)


def test_op3_query_against_counting(spark):
    """The query itself, on the whole small table: exact counts of words and pairs, the target by the quality model."""
    from collections import Counter

    import brute

    d = sf("0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = quality.fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    rows = quality.score_quality(docs, model).select("doc_id", "text", "quality_score").collect()
    words = {r.doc_id: brute.words(r.text) for r in rows}
    good = {r.doc_id for r in rows if r.quality_score >= 0.5}
    different = len({w for x in words.values() for w in x})
    got = by_id(lm_scoring.op3_lm_scoring(spark, d), "n_tokens", "target_loss", "background_loss", "lm_score")
    assert len(got) == len(rows) and 0 < len(good) < len(rows)
    losses = []
    for ids in (good, set(words)):
        one, two, first = Counter(), Counter(), Counter()
        for i in ids:
            w = words[i]
            one.update(w)
            first.update(["<s>", *w][: len(w)])
            two.update(zip(["<s>", *w], w, strict=False))
        n = sum(one.values())
        losses.append({i: np.mean([-np.log2((two[a, b] + lm_scoring.MASS * (one[b] + 0.5) / (n + 0.5 * (different + 2))) / (first[a] + lm_scoring.MASS)) for a, b in zip(["<s>", *w], w, strict=False)]) for i, w in words.items() if w})
    for i, w in words.items():
        want = (losses[0][i], losses[1][i], losses[0][i] - losses[1][i]) if w else (None, None, None)
        assert got[i] == (len(w), *(x if x is None else pytest.approx(x) for x in want))


# Personal data


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("x a.b@c.de y", [("email", 2, 10)]),
        ("a@b@c.de", [("email", 2, 8)]),
        ("a@b.c@d.e", [("email", 0, 5)]),
        ("é@c.de ok_@x-y.z.w.", [("email", 7, 18)]),
        ("1.2.3.4 256.1.1.1 0001.2.3.255", [("ip", 0, 7), ("ip", 18, 30)]),
        ("1.2.3.4.5.6.7.8", [("ip", 0, 7), ("ip", 8, 15)]),
        ("4111 1111 1111 1111", [("card", 0, 19)]),
        ("4111-1111-1111-1112", []),
        ("+1 (555) 123-4567 +12", [("phone", 0, 17)]),
        ("", []),
    ],
)
def test_patterns(text, want):
    assert [(pii.KINDS[k], s, e) for s, k, e in pii.base_spans(text)[0]] == want


def test_patterns_against_plain_regular_expressions():
    import random
    import re

    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("a@.1+2- (5)é") for _ in range(r.randint(0, 40)))
        want = sorted((m.start(), k, m.end()) for k, p in plain.items() for m in re.finditer(p, text) if k == 0 or pii._valid(k, m[0]))
        assert pii.base_spans(text)[0] == want, text
    assert pii.base_spans("1" * 50_000 + "a@" * 20_000 + "b" * 50_000)[0] == []


def test_gradient_of_the_tagger():
    r = np.random.default_rng(0)
    t = pii.Tagger(1)
    x, y = r.integers(0, 97, (2, 7)), r.integers(0, t.TAGS, (2, 7))
    _, grad = t.gradient(x, y)
    for name in t.p:
        at = tuple(r.integers(0, s) for s in t.p[name].shape)
        if name == "emb":
            at = (int(x[0, 0]), 0)
        old, ends = t.p[name][at], []
        for step in (1e-5, -1e-5):
            t.p[name][at] = old + step
            ends.append(t.gradient(x, y)[0])
        t.p[name][at] = old
        assert grad[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6), name


def test_tagger_finds_what_it_was_not_shown(spark):
    d = sf("0.1")
    tagger = pii.fit_tagger(spark.read.parquet(f"{d}/documents.parquet"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    hit = total = false = 0
    for text, (base, added) in zip(texts, pii.tagged(texts, tagger), strict=True):
        for s, e in pii.islands(text):
            for at in pii.windows(s, e):
                tags, _ = tagger.decode(pii._ids(text, at, e)[None])
                gold = pii._tags(base, at)
                hit, total, false = hit + int((tags[0][gold > 0] == gold[gold > 0]).sum()), total + int((gold > 0).sum()), false + int((tags[0][gold == 0] > 0).sum())
        assert not {x for x in added if any(x[0] < e and s < x[2] for s, _, e in base)}
    assert hit / total > 0.95 and false < 0.1 * total


def planted(n: int, seed: int = 77):
    """Texts of the corpus without any sign of personal data, each with one span that no pattern meets put between two words."""
    import random

    import pyarrow.parquet as pq

    r, rows = random.Random(seed), []
    clean = [t for t in pq.read_table(f"{sf('0.1')}/documents.parquet")["text"].to_pylist() if t and 200 < len(t) < 3000 and not pii.islands(t)]
    for t in clean[:n]:
        words, (kind, span) = t.split(" "), pii.rewritten(r)
        at = r.randrange(1, len(words))
        before = " ".join(words[:at]) + " "
        rows.append((before + span + " " + " ".join(words[at:]), f"{pii.KINDS[kind]}:{len(before)}:{len(before) + len(span)}"))
    return rows


def test_tagger_adds_spans_that_no_pattern_meets(spark):
    """Of 300 planted spans at least 80 % are found to the letter, and at least 85 % of what is added was planted."""
    tagger = pii.fit_tagger(spark.read.parquet(f"{sf('0.1')}/documents.parquet"))
    rows = planted(300)
    found = pii.tagged([t for t, _ in rows], tagger)
    spans = [pii.written(a).split(",") if a else [] for _, a in found]
    hit, total = sum(want in got for (_, want), got in zip(rows, spans, strict=True)), sum(map(len, spans))
    assert hit >= 0.8 * len(rows) and hit >= 0.85 * total


def test_windows_are_reconciled_over_a_whole_stretch(spark):
    tagger = pii.fit_tagger(spark.read.parquet(f"{sf('0.01')}/documents.parquet"))
    text = " ".join(str(i % 7) for i in range(1500)) + " mail someone_long.name [at] host.example.org or 4111.1111.1111.1111 now"
    tags, sure = tagger.read([text])[0]
    assert len(tags) == len(sure) == len(text) and sure.min() > 0 and sure.max() <= 1 + 1e-9
    for t in range(1, len(tags)):  # what is inside follows its own beginning
        assert tags[t] == 0 or tags[t] % 2 or tags[t - 1] in (tags[t], tags[t] - 1)
    short = [text[-90:], "call 1", text[:70]]
    for one, many in zip([tagger.read([s])[0] for s in short], tagger.read(short), strict=True):
        assert (one[0] == many[0]).all() and one[1] == pytest.approx(many[1])


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [(0, "a.b [at] c [dot] de", True), (0, "a @ b", False), (1, "1, 2, 3, 4", True), (1, "1, 2, 3, 400", False), (2, "4111.1111.1111.1111", True), (2, "4111.1111.1111.1112", False), (3, "555-123-4567", True), (3, "5551234567", False), (3, "(030) 123 4567", True), (3, "1-2-3", False)],
)
def test_added_spans_are_valid_when_written_plainly(kind, text, want):
    assert pii.plain(kind, text) == want


def test_op5_query_against_plain_regular_expressions(spark):
    import re

    d = sf("0.01")
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op5_personal_data(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id]) if k == 0 or pii._valid(k, m[0]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest() and set(pii.written(want).split(",")) <= {"", *r.spans.split(",")}


def test_redaction():
    assert pii.redact("mail a@b.de now", [(5, 0, 11)]) == "mail [EMAIL] now" and pii.redact("x", []) == "x"


# Media


def test_pictures_are_lossless(tmp_path, spark, docs):
    refs = media.store_media(docs.select("doc_id", "text"), tmp_path.as_uri())
    back = {r.digest: (bytes(r.payload), bytes(r.media)) for r in media.read_media(refs, tmp_path.as_uri()).collect()}
    want = {r.doc_id: media.payload(r.text) for r in docs.select("doc_id", "text").filter("doc_id is not null").collect()}
    members = {m.name: tarfile.open(p).extractfile(m).read() for p in Path(tmp_path).glob("*.tar") for m in tarfile.open(p)}
    for r in media.with_headers(refs, tmp_path.as_uri()).filter("doc_id is not null").collect():
        raw, picture = back[r.digest]
        assert raw == want[r.doc_id] and hashlib.sha256(raw).hexdigest() == r.digest and members[f"{r.digest}.png"] == picture
        assert (r.width, r.height, r.bits) == (576, len(raw) // 576, 8) and r.length == len(picture)
    assert media.payload(None) == b"\xff" * 576 and len(media.payload("x" * 577)) == 1152
    with pytest.raises(ValueError):
        media.decoded(picture[:50] + b"\x00" + picture[51:])
    with pytest.raises(ValueError):
        media.header(b"x" * 33)


def test_media_of_odd_tables(tmp_path, spark, docs, crowded, empty):
    refs = media.store_media(crowded, (tmp_path / "a").as_uri())
    assert refs.count() == docs.count() and set(refs.columns) == {*crowded.columns, "digest", "shard", "offset", "length", "n_bytes"} - {"text"}
    rows = media.with_headers(refs, (tmp_path / "a").as_uri()).collect()
    assert len(rows) == docs.count() and all((r.width, r.bits) == (576, 8) for r in rows)
    assert len({r.shard + str(r.offset) for r in rows}) == len({r.digest for r in rows})
    assert media.store_media(empty, (tmp_path / "b").as_uri()).count() == 0 and not (tmp_path / "b").exists()


def test_op6_digests(spark):
    d = sf("0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = media.op6_media_columns(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = media.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(texts[r.doc_id].encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), media.feature(raw))


def test_op6_keeps_little_beside_the_shards(spark):
    """A join by payload for each thing read back shuffled 700 bytes a row and more beside the shards, which are most of the disk."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        rows = media.op6_media_columns(spark, sf("0.1")).collect()
        assert 64 * len(rows) < shuffled(spark) - before < 480 * len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op6_of_odd_tables(tmp_path, spark, docs, empty):
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    for name, table in (("odd", docs), ("empty", empty)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = media.op6_media_columns(spark, str(tmp_path / name)).collect()
        texts = [(r.doc_id, len((r.text or "").encode()), media.payload(r.text)) for r in table.collect()]
        want = [(i, n, len(p), hashlib.sha256(p).hexdigest(), hashlib.sha256(media.encoded(p)).hexdigest(), len(p) // 576) for i, n, p in texts]
        assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.media_sha256, r.height) for r in rows), key=order) == sorted(want, key=order)
        assert len({(r.shard, r.offset) for r in rows}) == len({r.payload_sha256 for r in rows})


# SentencePiece

TEXTS = ["", None, " ", "  a", "\n", "a" * 300, "é́ﬁ①", " " * 40 + "x", "日本語 テキスト", "x" * 70000 + " hello" * 3, "\t\r\n  z", "<s> </s> <0x0A>", "hello world, hello"]


@pytest.fixture(scope="module")
def pieces():
    if not Path(subword.MODEL).exists():
        pytest.skip("needs the model's file")
    return subword.load()


def test_ids_are_those_of_the_library(spark, pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subword.MODEL)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf('0.001')}/documents.parquet").collect()]
    ids, at = subword.encode(texts, pieces)
    for i, t in enumerate(texts):
        mine = ids[at[i] : at[i + 1]].tolist()
        assert mine == sp.encode(t or "") and subword.decode(mine, pieces) == (t or "").replace("▁", " ")


def test_words_are_told_apart_by_characters(pieces, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subword.MODEL)
    texts = [*alike_to_a_polynomial(), *alike_to_a_polynomial("words"), "aa ab ba bb aa ba abc abd"]
    want = [sp.encode(t) for t in texts]
    for worst in (False, True):
        if worst:  # all words of one length share a hash
            monkeypatch.setattr(subword.T, "span_hash", lambda data, start, end, salt=0: (end - start).astype(np.uint64))
        ids, at = subword.encode(texts, pieces)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want


def test_encoding_round_trip_in_tables(spark, docs, pieces):
    rows = subword.encoded(docs, pieces)
    back = subword.decoded(rows, pieces)
    want = sorted((repr(r.doc_id), r.text or "") for r in docs.collect())
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == want
    assert subword.decode(None, pieces) is None


def test_viterbi_against_all_paths(pieces):
    import itertools

    words = ["▁hello", "▁abc", "xyz", "▁①a"]
    chars = subword.codes("".join(words))
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    size = subword._viterbi(subword.edges(chars, start, end, pieces), start, end, pieces)
    score = {t: s for t, s, n in zip(pieces.text, pieces.score, pieces.normal, strict=True) if n}
    lost = float(pieces.score.min()) - 10
    for w, s, e in zip(words, start, end, strict=True):
        best = max(sum(score.get(p, lost if len(p) == 1 else -np.inf) for p in (w[a:b] for a, b in itertools.pairwise([0, *c, len(w)]))) for k in range(len(w)) for c in itertools.combinations(range(1, len(w)), k))
        cuts = [0, *(np.flatnonzero(size[s:e])[1:]), len(w)]
        assert sum(score.get(w[a:b], lost) for a, b in itertools.pairwise(cuts)) == pytest.approx(best)


def test_whole_table_decodes_to_its_texts(spark):
    import hashlib

    if not Path(subword.MODEL).exists():
        pytest.skip("needs the model")
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = subword.op8_sentencepiece(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").replace("\u2581", " ").encode()).hexdigest()


# All of them on odd tables


def operators():
    return {
        "toxicity": lambda spark, docs, labels: toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)),
        "quality": lambda spark, docs, labels: quality.score_quality(docs, quality.fit_quality(docs, labels)),
        "lm": lambda spark, docs, labels: lm_scoring.score_lm(docs, *lm_scoring.fit_models(lm_scoring.marked(docs, labels.filter("quality = 1")))),
        "pii": lambda spark, docs, labels: pii.find_pii(docs),
        "redacted": lambda spark, docs, labels: pii.redacted(docs),
        "subword": lambda spark, docs, labels: subword.encoded(docs, subword.load()),
    }


@pytest.mark.parametrize("name", sorted(operators()))
def test_odd_tables(spark, docs, crowded, empty, labels, name):
    run = operators()[name]
    rows = run(spark, docs, labels).collect()
    assert len(rows) == docs.count()
    assert run(spark, crowded, labels).count() == docs.count()
    assert run(spark, empty, labels).count() == 0 and run(spark, docs, labels.limit(0)).count() == docs.count()
    twice = {}
    for r in rows:
        twice.setdefault(r["doc_id"], []).append({k: v for k, v in r.asDict().items() if k in ("tox_score", "quality_score", "lm_score", "spans", "ids")})
    assert twice[6][0] == twice[6][1]
