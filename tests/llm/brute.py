"""Plain Python versions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict


def lower(s: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def pii(text: str | None) -> list[str]:
    def fine(kind: str, s: str) -> bool:
        n = sum(c.isdigit() for c in s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= n <= 19 and luhn(s), "phone": 8 <= n <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, text or "") if fine(k, m.group())]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs: list[tuple], items: list[tuple]) -> dict:
    """doc: (n_words, n_hit, sorted items, contaminated)."""
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k : k + 13])].update([] if i is None else [str(i)])
    out = {}
    for d, t in docs:
        w = words(t)
        hit, own = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    own |= x
                    hit[k : k + n] = [1] * n
        out[d] = (len(w), sum(hit), sorted(own), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def near(docs: list[tuple], size: int) -> dict:
    """doc id: smallest id of its group."""
    sets = [(d, shingles(t, size)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: top(d) for d, _ in sets}


def lines(docs: list[tuple], min_docs: int, depth: int = 3, similar: float = 0.5, copy: float | None = None) -> dict:
    """doc: (places dropped, text that is left)."""

    def tokens(line: str) -> tuple:
        return tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\x0b\f\r]+", line) if t)

    parsed = {d: [tokens(x) for x in (t or "").split("\n")] for d, t in docs}
    leaves = defaultdict(lambda: defaultdict(set))  # leaf: line: documents
    for d, own in parsed.items():
        for x in own:
            if x:
                leaves[len(x), x[:depth]][x].add(d)
    dropped = set()
    for held in leaves.values():
        if len(set().union(*held.values())) < min_docs:
            continue
        support = defaultdict(set)
        for x, s in held.items():
            for i, t in enumerate(x):
                support[i, t] |= s
        for x in held:
            template = [t if t != "<*>" and len(support[i, t]) >= min_docs else None for i, t in enumerate(x)]
            fits = [s for y, s in held.items() if all(t is None or t == u for t, u in zip(template, y, strict=True))]
            if sum(t is not None for t in template) >= similar * len(x) and len(set().union(*fits)) >= min_docs:
                dropped.add(x)
    out = {}
    for d, t in docs:
        own = (t or "").split("\n")
        at = [i for i, x in enumerate(parsed[d]) if x and x in dropped]
        if at and copy is not None and sum(len(own[i]) for i in at) >= copy * sum(map(len, own)):
            at = []
        out[d] = (at, t if t is None or not at else "\n".join(x for i, x in enumerate(own) if i not in at))
    return out


def digest(parts: list[str]) -> str:
    return hashlib.sha256(",".join(parts).encode()).hexdigest()
