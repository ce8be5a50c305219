"""Plain Python twins of the contracts, for small tables."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None, fold: bool = True) -> list[bytes]:
    data = (text or "").encode()
    return WORD.findall(data.lower() if fold else data)  # bytes.lower folds A-Z only


def shingles(text: str | None, n: int = 5) -> set:
    w = words(text)
    if len(w) >= n:
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {tuple(w)} if w else set()


def components(texts: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable by links at 75 %."""
    sets = [(i, shingles(t)) for i, t in texts]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                if 100 * len(a & b) >= 75 * len(a | b):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def repeated_words(w: list, n: int = 8) -> int:
    runs: dict[tuple, list[int]] = {}
    for i in range(len(w) - n + 1):
        runs.setdefault(tuple(w[i : i + n]), []).append(i)
    return len({i + k for at in runs.values() if len(at) > 1 for i in at for k in range(n)})


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for order, (kind, pattern, fits) in enumerate(
        (
            ("email", EMAIL, lambda s: True),
            ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
            ("card", CARD, lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
            ("phone", PHONE, lambda s: 10 <= len(digits(s)) <= 15),
        )
    ):
        out += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if fits(m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]
