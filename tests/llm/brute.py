"""Brute-force versions of the corpus operators, over lists of rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np


def low(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


class Sets:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)

    def least(self, ids: list) -> list:
        groups = defaultdict(list)
        for i, x in enumerate(ids):
            groups[self.top(i)].append(x)
        return [min(groups[self.top(i)]) for i in range(len(ids))]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def private(text: str | None) -> dict[str, list[tuple[int, int]]]:
    def good(kind: str, found: str) -> bool:
        digits = re.sub("[^0-9]", "", found)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PATTERNS.items()}


def contaminated(docs: list[tuple], items: list[tuple]) -> dict:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {*map(len, windows)}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out[d] = len(w), len(hit), sorted(str(i) for i in found if i is not None)
    return out


def near_texts(docs: list[tuple], k: int, percent: int = 80) -> dict:
    def shingles(t: str | None) -> frozenset:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in docs]
    where, groups = defaultdict(list), Sets(len(sets))
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in where[g])
        for g in s:
            where[g].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
    return {d: (len(s), c) for (d, _), s, c in zip(docs, sets, groups.least([d for d, _ in docs]), strict=True)}


def near_vectors(rows: list[tuple], cosine: float) -> dict:
    good = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    groups, links = Sets(len(rows)), Counter()
    for i in good:
        for j in good:
            a, b = rows[i], rows[j]
            if i < j and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    groups.join(i, j)
    return {r[0]: (links[i], c) for i, (r, c) in enumerate(zip(rows, groups.least([r[0] for r in rows]), strict=True))}
