"""Personal data: exact patterns, and a character-level BiLSTM with a CRF that adds spans.

The patterns find e-mail addresses, IPv4 addresses, card numbers and telephone
numbers. The tagger is trained in numpy on labelled spans: those of the patterns
where they stand in the corpus, and, in windows of the corpus, spans written in
ways that no pattern meets (telephone numbers without plus sign or with slashes,
spelled-out or spaced addresses, cards with dots or runs of spaces). It reads
windows of WINDOW characters, half of which the next window shares, around every
stretch that holds a digit, "@", or a bracketed "at" or "dot".

Windows are reconciled globally: a character's emissions are the mean over its
windows, weighted by how central it is in each, and one Viterbi pass with the
CRF's transitions reads the tags of the whole stretch, so a span may cross any
number of windows. A span counts if the mean of its tags' marginals, by
forward-backward over the stretch, is SURE, if it is valid in its plain form
(Luhn, 255, digits, the shape of an address), and if it touches no span of the
patterns.

How the plan grows: texts are read where they are, once for the fit and once to
be tagged; nothing is shuffled but the windows of a sample whose size is fixed,
chosen by hashes, so the model does not depend on how rows are dealt out.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as T

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 64, 32, 24
#: At most so many windows of the corpus are taken for the fit, out of about so many documents, and so many with rewritten spans.
FIT_WINDOWS, FIT_DOCS, FIT_WRITTEN = 1536, 20_000, 2304
HIDDEN, EMBEDDED, EPOCHS, BATCH, RATE = 20, 10, 10, 96, 0.03
#: Documents that are tagged at once.
DOCS = 1024
#: The mean marginal of its tags from which a span of the tagger counts.
SURE = 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Behind a digit no match can begin that did not begin at the run's first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# What a stretch is built around: without one of these nothing can be personal data of the four kinds.
_SIGN = re.compile(r"[0-9@]+|[\[({<] ?(?:[aA][tT]|[dD][oO][tT]) ?[\])}>]")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _valid(kind: int, found: str) -> bool:
    if kind == 1:
        return all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in found.split(".")))
    digits = "".join(_DIGIT.findall(found))
    return 12 <= len(digits) <= 19 and _luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of _EMAIL, looked for only where there is an "@": a long text without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        if m := _EMAIL.match(text, begin):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans (start, kind, end) by start, then kind, and the matches that a check has turned down."""
    good = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    bad: list[Span] = []
    if _DIGIT.search(text):
        for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
            for m in pattern.finditer(text):
                (good if _valid(kind, m[0]) else bad).append((m.start(), kind, m.end()))
    return sorted(good), bad


def islands(text: str) -> list[tuple[int, int]]:
    """Stretches around the tokens that hold a digit, "@", or a bracketed "at" or "dot", MARGIN characters to each side, merged."""
    out: list[tuple[int, int]] = []
    for token in _SIGN.finditer(text):
        s, e = max(0, token.start() - MARGIN), min(len(text), token.end() + MARGIN)
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


_AT = re.compile(r" *(?:@|[\[({<] ?[aA][tT] ?[\])}>]) *")
_DOT = re.compile(r" *(?:\.|[\[({<] ?(?:[dD][oO][tT]|\.) ?[\])}>]) *")
_IP_DOT = re.compile(r" *(?:[.,·]|[\[({<] ?(?:[dD][oO][tT]|\.) ?[\])}>]) *")
_PLAIN_EMAIL = re.compile(_EMAIL.pattern + r"\Z")
_PLAIN_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
_CARD_MARKS = re.compile(r"[\x20\u00a0._/-]+")
_PHONE_SHAPE = re.compile(r"(?:\+|00|\()?[0-9][0-9\x20\u00a0()./-]*[0-9]\Z")


def plain(kind: int, found: str) -> bool:
    """Whether a span of the tagger, written plainly, is valid."""
    if kind == 0:
        return bool(_PLAIN_EMAIL.match(_DOT.sub(".", _AT.sub("@", found))))
    if kind == 1:
        form = _IP_DOT.sub(".", found)
        return bool(_PLAIN_IP.match(form)) and _valid(1, form)
    if kind == 2:
        form = _CARD_MARKS.sub("", found)
        return form.isascii() and form.isdigit() and _valid(2, form)
    # A number without a sign that dials is one only in groups.
    grouped = len(re.findall(r"[^0-9]+", found.strip("+("))) >= 2 or found[0] in "+("
    return bool(_PHONE_SHAPE.match(found)) and grouped and _valid(3, found)


def windows(start: int, end: int) -> list[int]:
    """Starts of the windows over a stretch, overlapping by half."""
    return [start, *range(start + STRIDE, max(start + STRIDE, end - WINDOW + STRIDE), STRIDE)] if end - start > WINDOW else [start]


def _ids(text: str, at: int, end: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    x = np.frombuffer(text[at : min(end, at + WINDOW)].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    out[: len(x)] = np.where((x >= 32) & (x < 127), x - 30, 1)
    return out


def _tags(spans: list[Span], at: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for s, kind, e in spans:
        if e > at and s < at + WINDOW:
            out[max(0, s - at) : e - at] = 2 + 2 * kind
            if s >= at:
                out[s - at] = 1 + 2 * kind
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """A bidirectional LSTM over characters with a CRF over 1 + 2 * len(KINDS) tags: none, begin, inside."""

    TAGS = 1 + 2 * len(KINDS)

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        h, d, k = HIDDEN, EMBEDDED, self.TAGS
        self.p = {"emb": r.normal(0, 0.3, (97, d)), "out": r.normal(0, 0.2, (2 * h, k)), "bias": np.zeros(k), "trans": np.zeros((k, k))}
        for way in "fb":
            self.p |= {f"w{way}": r.normal(0, 0.3, (d, 4 * h)), f"u{way}": r.normal(0, 0.2, (h, 4 * h)), f"c{way}": np.repeat([0.0, 1.0, 0.0, 0.0], h)}

    def _lstm(self, x: np.ndarray, way: str, keep: bool):
        """x: ids (batch, length), read from the left."""
        p, h_size = self.p, HIDDEN
        table = p["emb"] @ p[f"w{way}"] + p[f"c{way}"]
        n, length = x.shape
        h, c = np.zeros((n, h_size)), np.zeros((n, h_size))
        out, memory = np.empty((n, length, h_size)), []
        for t in range(length):
            z = table[x[:, t]] + h @ p[f"u{way}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h_size], -30, 30)))
            i, f, o = np.split(gates, 3, 1)
            g = np.tanh(z[:, 3 * h_size :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                memory.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[:, t] = h
        return out, memory

    def _lstm_back(self, x: np.ndarray, way: str, memory: list, d_out: np.ndarray, grad: dict) -> None:
        p, n = self.p, len(x)
        table = p["emb"] @ p[f"w{way}"]
        d_table = np.zeros_like(table)
        dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        for t in reversed(range(x.shape[1])):
            h, before, i, f, o, g, tc = memory[t]
            dh = dh + d_out[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grad[f"u{way}"] += h.T @ dz
            np.add.at(d_table, x[:, t], dz)
            dh, dc = dz @ p[f"u{way}"].T, dc * f
        grad[f"c{way}"] += d_table.sum(0)
        grad[f"w{way}"] += p["emb"].T @ d_table
        grad["emb"] += d_table @ p[f"w{way}"].T

    def scores(self, x: np.ndarray, keep: bool = False):
        forth, m1 = self._lstm(x, "f", keep)
        back, m2 = self._lstm(x[:, ::-1], "b", keep)
        both = np.concatenate([forth, back[:, ::-1]], 2)
        return both @ self.p["out"] + self.p["bias"], both, m1, m2

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y, and its gradient, by forward-backward."""
        n, length = x.shape
        e, both, m1, m2 = self.scores(x, True)
        a = self.p["trans"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + a, 1) + e[:, t]
        for t in reversed(range(length - 1)):
            beta[:, t] = _logsum(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        rows, at = np.arange(n)[:, None], np.arange(length)
        loss = z.sum() - e[rows, at, y].sum() - a[y[:, :-1], y[:, 1:]].sum()
        de[rows, at, y] -= 1
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["trans"] = pair.sum((0, 1))
        np.add.at(grad["trans"], (y[:, :-1], y[:, 1:]), -1)
        grad["out"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, self.TAGS)
        grad["bias"] = de.sum((0, 1))
        d_both = de @ self.p["out"].T
        self._lstm_back(x, "f", m1, d_both[:, :, :HIDDEN], grad)
        self._lstm_back(x[:, ::-1], "b", m2, d_both[:, ::-1, HIDDEN:], grad)
        return loss / n, {k: v / n for k, v in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> Tagger:
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            order = r.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                _, grad = self.gradient(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
                norm = max(1.0, np.sqrt(sum((g * g).sum() for g in grad.values())) / 5)
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g / norm
                    v[k] = 0.99 * v[k] + 0.01 * (g / norm) ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of windows, each on its own, and their marginals."""
        return self.best(self.scores(x)[0], np.full(len(x), x.shape[1]))

    def best(self, e: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each row of emissions (row, place, tag), by Viterbi over its first size places, and their marginals."""
        n, length, k = e.shape
        # Inside a span comes after its beginning or its inside, of the same kind.
        tag = np.arange(k)
        trans, rows = self.p["trans"] + np.where((tag > 0) & (tag % 2 == 0) & (tag[:, None] != tag) & (tag[:, None] != tag - 1), -1e4, 0.0), np.arange(n)
        best, back = e[:, 0], np.empty((n, length, k), np.int8)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        last = np.array(best)
        for t in range(1, length):
            on = (t < size)[:, None]
            paths = last[:, :, None] + trans
            back[:, t] = paths.argmax(1)
            last = np.where(on, paths.max(1) + e[:, t], last)
            alpha[:, t] = np.where(on, _logsum(alpha[:, t - 1, :, None] + trans, 1) + e[:, t], alpha[:, t - 1])
        for t in reversed(range(length - 1)):
            beta[:, t] = np.where((t + 1 < size)[:, None], _logsum(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _logsum(alpha[:, -1], 1)
        tags = np.zeros((n, length), np.int64)
        now = last.argmax(1)
        for t in reversed(range(length)):
            tags[:, t] = np.where(t < size, now, 0)
            if t:
                now = np.where(t < size, back[rows, t, now], now)
        marginal = np.exp(np.take_along_axis(alpha + beta, tags[:, :, None], 2)[:, :, 0] - z[:, None])
        return tags, marginal

    def read(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tags and marginals of each stretch: emissions of its windows are averaged, then decoded as a whole."""
        out: list = [None] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        at = 0
        while at < len(order):
            batch, cells = [], 0
            while at < len(order) and (not batch or (cells + len(stretches[order[at]]) < 1 << 15 and len(stretches[order[at]]) < 2 * len(stretches[batch[0]]) + WINDOW)):
                batch.append(order[at])
                cells += len(stretches[order[at]])
                at += 1
            size = np.array([len(stretches[i]) for i in batch])
            total = np.zeros((len(batch), int(size.max()), self.TAGS))
            weight = np.zeros(total.shape[:2])
            where = [(row, w) for row, i in enumerate(batch) for w in windows(0, len(stretches[i]))]
            for first in range(0, len(where), 1024):
                part = where[first : first + 1024]
                found = self.scores(np.stack([_ids(stretches[batch[row]], w, len(stretches[batch[row]])) for row, w in part]))[0]
                for (row, w), e in zip(part, found, strict=True):
                    n = min(WINDOW, int(size[row]) - w)
                    central = 1.0 + np.minimum(np.arange(n), np.arange(n)[::-1])
                    total[row, w : w + n] += e[:n] * central[:, None]
                    weight[row, w : w + n] += central
            tags, marginal = self.best(total / np.maximum(weight, 1e-9)[:, :, None], size)
            for row, i in enumerate(batch):
                out[i] = tags[row, : size[row]], marginal[row, : size[row]]
        return out


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.small(batches, DOCS):
        rows = []
        for text in batch.column("text").to_pylist():
            if not text or not (found := islands(text)):
                continue
            spans, bad = base_spans(text)
            # A failed match that swallowed what stands next to it is no example of what isn't personal data.
            unclear = [x for x in bad if x[1] == 3 or x[1] == 2 and any(plain(2, part) for part in text[x[0] : x[2]].split())]
            for s, e in found:
                for at in windows(s, e):
                    if not any(x < at + WINDOW and at < y for x, _, y in unclear):
                        piece = text[at : min(e, at + WINDOW)]
                        rows.append((zlib.crc32(piece.encode("utf-8", "replace")), piece, "".join(map(str, _tags(spans, at)))))
        marks, pieces, tags = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"mark": pa.array(marks, pa.int64()), "piece": pa.array(pieces, pa.string()), "tags": pa.array(tags, pa.string())})


def _luhn_number(r: random.Random) -> str:
    body = "".join(r.choice("0123456789") for _ in range(r.choice((14, 15, 15, 15, 15))))
    return next(body + d for d in "0123456789" if _luhn(body + d))


def rewritten(r: random.Random) -> tuple[int, str]:
    """A span of a kind, written in one of the ways that no pattern meets."""
    kind, digits = r.randrange(4), lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    left, right = r.choice(("[]", "()", "{}", "<>"))
    gap = r.choice(("", " "))
    if kind == 0:
        name = r.choice((word(), f"{word()}.{word()}", f"{word()}_{digits(2)}", f"{word()}.{digits(2)}"))
        host = [word() + r.choice(("", digits(1))), *([word()] if r.random() < 0.4 else []), r.choice(("com", "org", "net", "de", "fr", "es"))]
        at = r.choice((" @ ", "@ ", " @", *[gap + left + r.choice(("at", "AT", " at ")) + right + gap] * 3))
        return 0, name + at + r.choice((".", *[gap + left + "dot" + right + gap] * (at.strip() != "@"), *[" . "] * (at == " @ "))).join(host)
    if kind == 1:
        return 1, r.choice((" . ", ". ", ", ", ",", f"{left}.{right}", f"{left}dot{right}", f" {left}dot{right} ")).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        number, mark = _luhn_number(r), r.choice((".", "  ", " - ", "/", "_", "\u00a0", ". "))
        return 2, mark.join(number[i : i + 4] for i in range(0, len(number), 4))
    a, b, c = digits(3), digits(3), digits(4)
    return 3, r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} / {b} {c}", f"001 {a} {b} {c}", f"00{digits(2)} {a} {b}{c}", f"+{digits(1)}/{a}/{b}/{c}", f"1 ({a}) {b}-{c}", f"({a}) {b} {c}"))


def distractor(r: random.Random) -> str:
    """Digits that are no personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    return r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(2)}", d(1), d(2), d(3), f"{d(4)}-{d(4)}", f"{d(1)},{d(3)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}.{d(2)}.20{d(2)}", f"#{d(6)}", f"{d(2)} / {d(2)}", f"{d(3)} {d(3)}", f"{d(3)}-{d(3)}", f"({d(2)})", f"{d(5)}", f"{d(7)}", f"{d(2)}, {d(2)}, {d(2)}", f"v{d(1)}.{d(1)}", "@", "@here", f"@{d(2)}", "[at] the"))


def written_windows(pieces: list[str], n: int, seed: int = 9) -> tuple[list[str], list[list[Span]]]:
    """n windows made of the words of pieces, with rewritten spans and distractors among them, and their spans."""
    r, texts, spans = random.Random(seed), [], []
    words = sorted({w for p in pieces for w in re.findall(r"\S+", p) if not _SIGN.search(w)}) or ["the", "of", "and", "la", "der"]
    for _ in range(n):
        text, found = "", []
        while len(text) < WINDOW:
            draw = r.random()
            if draw < 0.2:
                kind, span = rewritten(r)
                found.append((len(text), kind, len(text) + len(span)))
                text += span
            elif draw < 0.35:
                text += distractor(r)
            else:
                text += r.choice(words)
            text += r.choice((" ", " ", " ", " ", ", ", ". ", "\n", "; "))
        cut = r.randrange(0, max(1, len(text) - WINDOW + 1))
        texts.append(text[cut : cut + WINDOW])
        spans.append([(s - cut, k, e - cut) for s, k, e in found if e > cut and s < cut + WINDOW])
    return texts, spans


def fit_tagger(docs: DataFrame, limit: int = FIT_WINDOWS, sample: int = FIT_DOCS) -> Tagger:
    """A tagger fitted to limit windows of the corpus at most, labelled by the patterns, and FIT_WRITTEN with rewritten spans.

    The windows come from about sample rows, chosen by a hash of all of a row.
    """
    share = min(1.0, sample / max(1, docs.count()))
    unit = F.shiftrightunsigned(F.xxhash64(*[c for c in ("doc_id", "text") if c in docs.columns]), 11) / F.lit(float(1 << 53))
    found = docs.filter(unit < share).select("text").mapInArrow(_examples, "mark bigint, piece string, tags string")
    rows = found.orderBy("mark", "piece", "tags").limit(limit).collect()
    texts, spans = written_windows([r.piece for r in rows], FIT_WRITTEN)
    x = np.stack([_ids(t, 0, len(t)) for t in [r.piece for r in rows] + texts])
    return Tagger().fit(x, np.array([[int(c) for c in r.tags] for r in rows] + [_tags(s, 0).tolist() for s in spans]))


def tagged(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns, and those that the tagger adds."""
    base = [base_spans(t)[0] for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    where = [(i, s, e) for i, t in enumerate(texts) for s, e in islands(t)] if tagger else []
    for (i, s, e), (tags, sure) in zip(where, tagger.read([texts[i][s:e] for i, s, e in where]) if where else [], strict=True):
        at, mine = 0, [x for x in base[i] if x[0] < e and s < x[2]]
        while at < e - s:
            tag, end = tags[at], at + 1
            if tag % 2:
                while end < e - s and tags[end] == tag + 1:
                    end += 1
                span = (s + at, int(tag) // 2, s + end)
                if end - at >= 6 and sure[at:end].mean() >= SURE and plain(span[1], texts[i][span[0] : span[2]]) and not any(x < span[2] and span[0] < y for x, _, y in mine):
                    added[i].append(span)
            at = end
    return list(zip(base, added, strict=True))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in sorted(spans))


def find_pii(docs: DataFrame, tagger: Tagger | None = None, fit: bool = True) -> DataFrame:
    """docs with base_spans and spans: "kind:start:end" by start, comma-joined, in code points, end exclusive.

    spans holds those of the patterns and those that the tagger adds.
    Defined cases: a null text counts as empty and has no spans; the pattern's
    spans may overlap between kinds and all stay; an empty table, or one
    without digits and "@", is fitted to rewritten spans alone; repeated rows get
    equal spans; columns of docs by these names are replaced, others pass.
    """
    docs = docs.drop("base_spans", "spans")
    tagger = fit_tagger(docs) if tagger is None and fit else tagger

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.small(batches, DOCS):
            both = tagged([t or "" for t in batch.column("text").to_pylist()], tagger)
            yield T.with_columns(batch, {"base_spans": pa.array([written(b) for b, _ in both], pa.string()), "spans": pa.array([written(b + a) for b, a in both], pa.string())})

    return docs.mapInArrow(run, T.schema_of(docs.schema, "base_spans string", "spans string"))


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, done = [], 0
    for s, kind, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"[{KINDS[kind].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by its kind in brackets; null stays null."""
    tagger = fit_tagger(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.small(batches, DOCS):
            texts = batch.column("text").to_pylist()
            found = tagged([t or "" for t in texts], tagger)
            yield T.with_columns(batch, {"text": pa.array([None if t is None else redact(t, b + a) for t, (b, a) in zip(texts, found, strict=True)], pa.string())})

    return docs.mapInArrow(run, T.schema_of(docs.schema))


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text; the counts are of the patterns' spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    each = F.split("base_spans", ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(each, lambda x: x.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")
