"""Plain Python versions of conversation repair and source divergence."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

from brute import lower

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        part = [" " if x is None else str(x) for x in (conv, turn)]
        kind = zlib.crc32(":".join(part).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def repaired(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, text of one conversation's damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    kinds, seen = [], set()
    for _, role, text in rows:
        shown = SPACE.findall(text)
        kinds.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @cache
    def best(at: int, state: str, inserted: int) -> tuple | None:
        """Cheapest (cost, audit, lines) from row `at` on, the grammar being at state; at most two insertions in a row."""
        ways = []
        if at == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))

        def add(cost: int, letter: str, line: tuple, then: tuple | None) -> None:
            if then is not None:
                ways.append((cost + then[0], letter + then[1], line + then[2]))

        if inserted < 2:
            new = "assistant" if state == "u" else "user"
            add(5, "I", (f"{new}:",), best(at, new[0], inserted + 1))
        if at < len(rows):
            _, role, text = rows[at]
            add(2, "D", (), best(at + 1, state, 0))
            if kinds[at] not in ("blank", "duplicate"):
                more = 5 if kinds[at] == "truncated" else 0
                fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[:1] in fits:
                    add(more, "K", (f"{role}:{text}",), best(at + 1, role[0], 0))
                for new in ("user", "assistant"):
                    if new[0] in fits:
                        add(1 + more, "R", (f"{new}:{text}",), best(at + 1, new[0], 0))
        return min(ways) if ways else None

    cost, audit, lines = best(0, "", 0)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, "\n".join(lines))


def op12(rows: list[tuple]) -> dict:
    convs = defaultdict(list)
    for conv, *rest in damage(rows):
        convs[conv].append(tuple(rest))
    out = {}
    for conv in {r[0] for r in rows}:
        found = repaired(convs[conv])
        out[conv] = (*found[:-1], hashlib.sha256(found[-1].encode()).hexdigest())
    return out


def op13(docs: list[tuple], min_docs: int = 10, top: int = 10) -> set:
    """(lang, source, part, item, value, rank) of documents (text, lang, source)."""
    uses, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        groups[lang].add(source)
        uses[lang, source].update(own)
        holders[lang].update(own.keys())
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        of = {s: {t: uses[lang, s][t] for t in kept} for s in sources}
        of[None] = {t: sum(of[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()} for s, c in of.items()}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if of[s][t] > 0 and p[s][t] > p[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)}
    return out
