"""Plain versions of what the operators must return, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def letters(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def shingles(text: str | None) -> frozenset:
    w = words(ascii_lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)]


def word_windows(rows: list[tuple], k: int = 13) -> list[tuple]:
    last = 1 << 70
    first: dict[tuple, int] = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, last), last if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < (last if d is None else d):
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_strings(rows: list[tuple], depth: int = 100) -> list[tuple]:
    seen: set[bytes] = set()
    out = []
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            s = b[i : i + depth]
            if s in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def benchmark(rows: list[tuple], items: list[tuple], size: int = 8) -> list[tuple]:
    held = defaultdict(set)
    for item, t in items:
        w = letters(t)
        if item is not None and w:
            for i in range(max(1, len(w) - size + 1)):
                held[tuple(w[i : i + size])].add(str(item))
    out = []
    for d, t in rows:
        w, hit, found = letters(t), set(), set()
        for i in range(len(w)):
            for n in {len(x) for x in held}:
                if (got := held.get(tuple(w[i : i + n]))) and i + n <= len(w):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def secrets(rows: list[tuple]) -> list[tuple]:
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = []
    for d, t in rows:
        t = t or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(s[2] for s in spans)
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
        out.append((d, n["assign"], n["access"], n["hex"], hashlib.sha256(text.encode()).hexdigest()))
    return out


def licenses(rows: list[tuple]) -> list[tuple]:
    base = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    out = []
    for d, t in rows:
        w = letters(t)
        at = [(i, label) for i in range(len(w)) for p, label in base.items() if tuple(w[i : i + len(p)]) == p]
        out.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    return out


def quality(rows: list[tuple]) -> list[tuple]:
    out = []
    for d, t in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = set()
        for i in range(len(w) - 4):
            if n[tuple(w[i : i + 5])] > 1:
                hit.update(range(i, i + 5))
        out.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    return out


def grams(text: str) -> Counter:
    """Letter n-grams of one to three in words padded with a blank: single letters, pairs, and triples around a letter."""
    out: Counter = Counter()
    for run in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        w = "\1" + run + "\1"
        out.update(run)
        out.update(w[i : i + 2] for i in range(len(w) - 1))
        out.update(w[i : i + 3] for i in range(len(w) - 2))
    return out


def ranked(n: Counter, size: int) -> list[str]:
    return sorted(n, key=lambda g: (-n[g], len(g), g))[:size]


def languages(rows: list[tuple], size: int = 400) -> list[tuple]:
    """Of (doc_id, text, lang): doc_id, held_out, the language of the least out-of-place distance, and the score."""
    held = [zlib.crc32(str(d).encode()) % 4 == 2 for d, *_ in rows]
    total: dict[str, Counter] = defaultdict(Counter)
    for (_, t, lang), h in zip(rows, held):
        if lang is not None and t is not None and not h:
            total[lang] += grams(t)
    place = {lang: {g: i for i, g in enumerate(ranked(n, size))} for lang, n in sorted(total.items())}
    out = []
    for (d, t, _), h in zip(rows, held):
        own = ranked(grams(t or ""), size)
        if not own:
            out.append((d, h, "und", 0.0))
            continue
        apart = {lang: sum(abs(i - p[g]) if g in p else size for i, g in enumerate(own)) for lang, p in place.items()}
        best = min(apart, key=apart.get)
        out.append((d, h, best, 1 - apart[best] / (size * len(own))))
    return out


def toxic_score(text: str | None, weight: dict[int, float], bias: float, number) -> float:  # noqa: ANN001
    """One minus the chance that no sentence is toxic."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        w = re.findall(r"[^\W_]+", sentence)
        if w:
            z = max(-60.0, min(60.0, sum(weight.get(number(x), 0.0) for x in w) + bias))
            clean *= 1 - min(1 - 1e-12, 1 / (1 + math.exp(-z)))
    return 1 - clean
