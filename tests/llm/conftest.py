import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i * i % 977}" for i in range(4000))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and blank texts, a very long one, copies, near copies, a repeated row."""
    base = [f"{a} {b} and then some more" for a, b in (("alpha", "beta"), ("gamma", "delta"))]
    passage = " ".join(f"passage{i}" for i in range(60))
    near = [" ".join(f"n{i}" for i in range(120)) + f" end{j}" for j in range(5)]
    texts = [None, "", " \t\n", "one", LONG, LONG, *base, *base, *near, f"before {passage} after", f"other {passage} tail", "ÀÉ ß 日本語 \U0001f600", "you are a worthless idiot and pathetic.", "mail a.b@c.de or +1 (555) 123-4567"]
    out = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[6], (None, "a row without an id at all here", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def crowded(docs):
    """docs with further columns by names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ("size", "taken", "cls", "comp", "band", "bands", "spans", "base_spans", "label", "score", "ids", "n_tokens", "h", "c", "pos", "k0", "k1", "digest", "shard", "offset", "length", "word", "n", "id", "vec", "mix_size", "tox_score", "quality_score", "lm_score", "n_bytes", "kept", "one", "at")
    return docs.select("*", *[F.lit(7).alias(x) for x in names])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    data = [(r[0], int(r[0] % 7 != 3), int("idiot" in (r[1] or ""))) for r in rows if r[0] is not None]
    return spark.createDataFrame([*data, (None, 1, 1), (2, None, None), (10**9, 1, 0)], "doc_id bigint, quality int, toxic int")


def sf(name: str) -> str:
    path = f"/root/testdata/sf{name}"
    if not Path(path).exists():
        pytest.skip("needs the test tables")
    return path


def alike_to_a_polynomial(kind: str = "text") -> list[str]:
    """Pairs that differ at all 1,024 places and that no polynomial modulo 2^64 tells apart: the Thue-Morse word over random text, and its complement."""
    import random

    r = random.Random(3)
    bit = [bin(i).count("1") % 2 for i in range(1024)]
    base = [r.randrange(97, 120, 2) for _ in bit]
    out = ["".join(chr(c + (b ^ flip)) for c, b in zip(base, bit, strict=True)) for flip in (0, 1)]
    if kind == "words":
        out = [" ".join(x[i : i + 8] for i in range(0, 1024, 8)) for x in out]
    return out
