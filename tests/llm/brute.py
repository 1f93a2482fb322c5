"""Plain Python versions of what operators compute, for small inputs."""

from __future__ import annotations


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int, bool]]:
    """doc_id to (n_shingles, component_id, kept), for rows with different ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    by: dict[tuple, list[int]] = {}
    for i in sets:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    seen = set()
    for ids in by.values():
        for x in ids:
            for y in ids:
                if x < y and (x, y) not in seen:
                    seen.add((x, y))
                    both = len(sets[x] & sets[y])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        a, b = sorted((root(x), root(y)))
                        up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def repeats(rows: list[tuple[int, str | None]], length: int = 200) -> dict[int, tuple[int, int, int, str]]:
    """doc_id to (n_bytes, n_removed, n_spans, kept_sha256), for rows with different ids."""
    import hashlib
    from collections import Counter

    raw = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[s : s + length] for b in raw.values() for s in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        runs = sum(1 for s in range(len(b)) if gone[s] and (s == 0 or not gone[s - 1]))
        out[i] = len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


def toxic_events(text: str, lexicon, toxicity) -> list[float]:
    """Summed weights by toxicity.WAYS, by looking around each word."""
    import re

    low, out = text.lower(), [0.0] * 5
    often = {t: x for t, x in lexicon.repeated.items() if sum(low.startswith(t, p) and (p == 0 or not low[p - 1].isalnum()) for p in range(len(low))) >= toxicity.REPEATS}
    for clause in re.split(r"[.!?;:\n\r]+", low):
        found = re.findall(r"\w+|[\"“”„«»]", clause)
        weight = [max([lexicon.whole.get(w, 0.0)] + [x for s, x in lexicon.stems.items() if w.startswith(s)] + [x for s, x in often.items() if w.startswith(s)]) for w in found]

        def is_a(group, i, found=found, weight=weight):
            return 0 <= i < len(found) and not weight[i] and found[i] in group

        quoted, said, reported = False, False, []
        for i, w in enumerate(found):
            mark = not weight[i] and w in "\"“”„«»"
            reported.append(said or quoted and not mark)
            if not said:
                said = not quoted and is_a(toxicity.REPORTS, i)
                quoted = quoted != mark
        armed, skip = set(), -1
        for i in range(len(found)):  # harm within three words of the last intent; two words later it is forgotten
            intent = [p for p in range(i - 3, i) if p > skip and is_a(toxicity.INTENT, p)]
            if i > skip and intent and is_a(toxicity.HARM, i):
                armed.add(i)
                skip = i + 1 if is_a(toxicity.TARGETS, i + 1) else i + 2
        for i in range(len(found)):
            negated = any(is_a(toxicity.NEGATIONS, p) for p in range(i - 3, i))
            if weight[i]:
                near = any(is_a(toxicity.TARGETS, p) for p in [*range(i - 4, i), *range(i + 1, i + 5)])
                out[2 if negated else 3 if reported[i] else 1 if near else 0] += weight[i]
            if is_a(toxicity.TARGETS, i) and (i - 1 in armed or i - 2 in armed and not is_a(toxicity.TARGETS, i - 1)):
                out[2 if negated else 3 if reported[i] else 4] += 4.0
    return out


def quality_features(text: str | None) -> list[float]:
    import math
    import re
    from collections import Counter

    raw = (text or "").encode()
    found = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    low = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in found]
    size, n = max(1, len(raw)), max(1, len(found))
    odd = b"!#$%&*+/<=>@[\\]^_`{}~"
    share = lambda chars: sum(c in chars for c in raw) / size
    counts = Counter(low)
    return [
        math.log1p(len(raw)),
        math.log1p(len(found)),
        sum(map(len, found)) / n,
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        share(b"0123456789"),
        share(odd),
        share(b"|"),
        sum(c >= 128 for c in raw) / size,
        raw.count(b"\n") / n,
        sum(c in b".,;:?" for c in raw) / n,
        len(counts) / n,
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / n,
        max(counts.values(), default=0) / n,
        sum(w[-1] in odd + b"|" for w in found) / n,
    ]
