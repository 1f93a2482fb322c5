"""Toxicity by a weighted finite-state grammar over clauses.

A clause's words become symbols: insults (from a lexicon with weights), harm
verbs, intent, targets, negations, words of reported speech and quotation marks.
Five transducers read the symbols in step, as one composed machine whose
transitions are made when first needed: insult, threat (intent, then harm, then
a target), target (near an insult, on either side), negation (for a few words
after it) and reported speech (for the rest of the clause). What comes out is a
weight for each matched event and how it was meant; a document's score is a
logistic function of these sums.

Learned from labelled rows: the lexicon (whole words and beginnings of words
that mark toxic documents by a likelihood-ratio test) and the weights of the
five ways in which an event can be meant. At most FIT_EACH documents of either
label are used. The texts are scored where they are, without a shuffle; a model
is a few hundred terms and six numbers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._labels import held_out, training

FIT_EACH = 3000
#: Terms in a lexicon at most, the likelihood ratio and log odds ratio that a term needs, and lengths of beginnings of words.
MAX_TERMS, RATIO, ODDS, STEMS = 400, 20.0, 5.0, (4, 5, 6, 7, 8)
#: Words with one beginning that make it count where a single one is too common in clean texts.
REPEATS = 3
THRESHOLD = 0.3
#: What a document without any event scores before rows have been learned from, and weights of the five ways.
PRIOR = (-3.0, np.array([2.0, 2.5, 0.6, 0.8, 2.5]))
#: Words of the grammar.
INSULTS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "loser", "disgusting", "trash", "imbecile")
INTENT = ("will", "gonna", "shall", "going", "must", "should", "werde", "vais", "voy")
HARM = ("kill", "hurt", "destroy", "beat", "murder", "burn", "shoot", "stab", "crush")
TARGETS = ("you", "your", "yours", "he", "she", "they", "them", "him", "her", "his", "their", "du", "dich", "ihr", "tu", "toi", "vous", "usted", "ellos")
NEGATIONS = ("not", "no", "never", "nobody", "neither", "nor", "nicht", "kein", "keine", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "claimed", "claims", "wrote", "reported", "reportedly", "called", "quoted", "sagte", "disait", "dijo")

_CLAUSE = re.compile(r"[.!?;:\n\r]+")
_SYMBOL = re.compile(r"\w+|[\"“”„«»]")
_CLASSES = {w: name for name, group in (("intent", INTENT), ("harm", HARM), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in group}
#: Ways in which an event is meant, in the order of the weights.
WAYS = ("plain", "targeted", "negated", "reported", "threat")


@dataclass
class Transducer:
    """arcs: (state, symbol) to (state, output); "*" stands for any other symbol."""

    arcs: dict[tuple[int, str], tuple[int, int]]

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        return self.arcs.get((state, symbol)) or self.arcs[(state, "*")]


def _within(symbol: str, words: int) -> Transducer:
    """Puts out 1 for so many words after a symbol."""
    arcs = {(s, symbol): (words, int(s > 0)) for s in range(words + 1)}
    return Transducer(arcs | {(s, "*"): (max(0, s - 1), int(s > 0)) for s in range(words + 1)})


INSULT = Transducer({(0, "insult"): (0, 1), (0, "*"): (0, 0)})
NEGATION = _within("negation", 3)
TARGET = _within("target", 4)
# State 1 after a word of saying, 2 inside quotation marks.
REPORTED = Transducer({(0, "report"): (1, 0), (0, "quote"): (2, 0), (0, "*"): (0, 0), (1, "*"): (1, 1), (2, "quote"): (0, 0), (2, "*"): (2, 1)})
# Intent holds for three words, harm for two; a target then completes a threat.
THREAT = Transducer(
    {(0, "*"): (0, 0), (0, "intent"): (3, 0)}
    | {(s, "*"): (s - 1, 0) for s in (1, 2, 3)}
    | {(s, "intent"): (3, 0) for s in (1, 2, 3)}
    | {(s, "harm"): (5, 0) for s in (1, 2, 3)}
    | {(5, "*"): (4, 0), (4, "*"): (0, 0), (5, "target"): (0, 1), (4, "target"): (0, 1)}
)


@dataclass
class Composed:
    """Transducers that read the same symbols; a state is the tuple of theirs."""

    parts: tuple[Transducer, ...]
    made: dict = field(default_factory=dict)

    def run(self, symbols: Iterable[str]) -> Iterator[tuple[int, ...]]:
        state = (0,) * len(self.parts)
        for symbol in symbols:
            arc = self.made.get((state, symbol))
            if arc is None:
                steps = [p.step(s, symbol) for p, s in zip(self.parts, state, strict=True)]
                arc = self.made[(state, symbol)] = tuple(s for s, _ in steps), tuple(o for _, o in steps)
            state = arc[0]
            yield arc[1]


FORWARD = Composed((INSULT, NEGATION, TARGET, REPORTED, THREAT))
#: Read from the right, for a target that follows.
BACKWARD = Composed((TARGET,))


class Lexicon:
    """Insults with weights: whole words, beginnings of words, and beginnings that count from the REPEATS-th word with them on."""

    def __init__(self, whole: dict[str, float], stems: dict[str, float], repeated: dict[str, float] | None = None) -> None:
        self.whole, self.stems, self.repeated = whole, stems, repeated or {}
        self.lengths = sorted({len(s) for s in stems})
        self._finder = None

    def __getstate__(self):
        return self.__dict__ | {"_finder": None}

    def weight(self, word: str, active: dict[str, float]) -> float:
        found = [self.whole.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths)]
        return max(found + [x for s, x in active.items() if word.startswith(s)])

    def touched(self, text: str) -> tuple[bool, dict[str, float]]:
        """Whether a term is anywhere in a text, and which repeated ones count, by one automaton; most texts end here."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for term in {*self.whole, *self.stems, *self.repeated, *HARM}:
                self._finder.add_word(term, term)
            self._finder.make_automaton()
        some, counts = False, dict.fromkeys(self.repeated, 0)
        for end, term in self._finder.iter(text):
            if term in counts:
                start = end - len(term)
                counts[term] += start < 0 or not text[start].isalnum()
            if term not in counts or term in self.whole or term in self.stems:
                some = True
        active = {t: self.repeated[t] for t, n in counts.items() if n >= REPEATS}
        return some or bool(active), active


def events(text: str, lexicon: Lexicon) -> np.ndarray:
    """The summed weights of a text's events by WAYS."""
    out = np.zeros(len(WAYS))
    low = text.lower()
    some, active = lexicon.touched(low)
    if not some:
        return out
    for clause in _CLAUSE.split(low):
        found = _SYMBOL.findall(clause)
        weights = [lexicon.weight(w, active) for w in found]
        symbols = ["insult" if x else _CLASSES.get(w, "quote" if not w[0].isalnum() and w[0] != "_" else "*") for w, x in zip(found, weights, strict=True)]
        if "insult" not in symbols and "harm" not in symbols:
            continue
        behind = list(BACKWARD.run(reversed(symbols)))[::-1]
        for x, (insult, negated, target, reported, threat), (ahead,) in zip(weights, FORWARD.run(symbols), behind, strict=True):
            if insult:
                out[2 if negated else 3 if reported else 1 if target or ahead else 0] += x
            if threat:
                out[2 if negated else 3 if reported else 4] += 4.0
    return out


@dataclass
class Model:
    lexicon: Lexicon
    intercept: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        x = self.intercept + float(np.log1p(events(text or "", self.lexicon)) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct terms of each text with its label, and "" once for the text itself."""
    for batch in batches:
        terms, marks = [], []
        for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            each = Counter(w for w in _SYMBOL.findall((text or "").lower()) if len(w) > 2)
            often: Counter[str] = Counter()
            for w, k in each.items():
                for n in STEMS:
                    if len(w) > n:
                        often[w[:n]] += k
            mine = {""} | {"=" + w for w in each} | {"^" + p for p in often} | {"*" + p for p, k in often.items() if k >= REPEATS}
            terms += mine
            marks += [y] * len(mine)
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "label": pa.array(marks, pa.int32())})


def _ratio(a: float, n: float, b: float, m: float) -> float:
    """Twice the log-likelihood ratio of a of n against b of m."""
    p = (a + b) / (n + m)
    part = lambda x, size, q: x * math.log(x / size / q) if x else 0.0
    return 2 * (part(a, n, p) + part(n - a, n, 1 - p) + part(b, m, p) + part(m - b, m, 1 - p)) if 0 < p < 1 else 0.0


def grown(lexicon: Lexicon, counts: Iterable[tuple[str, int, int]], n: int, m: int) -> Lexicon:
    """lexicon with terms from (term, toxic texts with it, clean texts with it), of n and m texts.

    A term's log odds ratio has to reach ODDS, or it is in a tenth of the toxic
    texts and in no clean one: groups of copies lend chance words a little
    evidence, but not so much.
    """
    good = []
    for term, a, b in counts:
        x = math.log((a + 0.5) / (n - a + 0.5)) - math.log((b + 0.5) / (m - b + 0.5))
        if _ratio(a, n, b, m) >= RATIO and (x >= ODDS or not b and a >= 0.1 * n):
            good.append((x, term))
    tables = {"=": dict(lexicon.whole), "^": dict(lexicon.stems), "*": dict(lexicon.repeated)}
    # Single words last: most are explained by a beginning that they share with others.
    for x, term in sorted(good, key=lambda g: ("^*=".index(g[1][0]), len(g[1]), g[1])):
        word, covers = term[1:], tables["^"] if term[0] == "^" else tables["^"] | tables["*"]
        if not any(word.startswith(s) for s in covers):
            tables[term[0]][word] = min(8.0, max(x, tables["="].get(word, 0.0)))
    return Lexicon(tables["="], tables["^"], tables["*"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Weights that never count against toxicity, by projected gradient descent with both labels of equal weight."""
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b, w = PRIOR[0], PRIOR[1].copy()
    rate = 4.0 / (1 + (x * x).sum(1).mean())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + x @ w, -30, 30)))
        d = share * (p - y)
        b -= rate * (d.mean() + ridge * (b - PRIOR[0]) / len(y))
        w = np.maximum(0.05, w - rate * (x.T @ d / len(y) + ridge * (w - PRIOR[1]) / len(y)))
    return min(b, -1.5), w


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, each: int = FIT_EACH) -> Model:
    """A model of labels.toxic, from at most each documents of either label that are not held out.

    Without labelled rows of both kinds the fixed insults and weights stand.
    """
    rows = training(docs, labels, "toxic", modulus, rest, each).cache()
    lexicon = Lexicon({w: 4.0 for w in INSULTS}, {})
    counts = rows.mapInArrow(_terms, "term string, label int").groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).cache()
    n, m = next(((r.a, r.b) for r in counts.filter("term = ''").collect()), (0, 0))
    if n and m:
        # The ratio can't reach RATIO with fewer toxic texts.
        likely = counts.filter((F.col("term") != "") & (F.col("a") >= RATIO / 2 / math.log((n + m) / n)) & (F.col("a") * m > 10 * F.col("b") * n))
        lexicon = grown(lexicon, [tuple(r) for r in likely.orderBy(F.desc(F.col("a") - F.col("b") * n / m), "term").limit(MAX_TERMS).collect()], n, m)
    counts.unpersist()

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [events(t or "", lexicon).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": batch.column("label")})

    found = rows.mapInArrow(seen, "x array<double>, y int").collect()
    rows.unpersist()
    if len({r.y for r in found}) < 2:
        return Model(lexicon, *PRIOR)
    x, y = np.log1p(np.array([r.x for r in found])), np.array([r.y for r in found])
    order = np.lexsort((*x.T, y))  # sums in a fixed order
    return Model(lexicon, *_logistic(x[order], y[order]))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs with tox_score from 0 to 1; only the text counts.

    Defined cases: a null or empty text has no event and gets the lowest
    score; equal texts get equal scores; an input column tox_score is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield T.with_columns(batch, {"tox_score": pa.array([model.score(t) for t in batch.column("text").to_pylist()], pa.float64())})

    docs = docs.drop("tox_score")
    return docs.mapInArrow(run, T.schema_of(docs.schema, "tox_score double"))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels of those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"))
