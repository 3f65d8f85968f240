"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

BASE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def personal(text: str) -> list[tuple[int, int, int]]:
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True if name == "email"
                else all(int(p) <= 255 for p in m[0].split(".")) if name == "ip"
                else 14 <= len(digits) <= 19 and luhn(digits) if name == "card"
                else 10 <= len(digits) <= 15
            )
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def spans_text(spans) -> str:
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def groups(n: int, linked) -> list[int]:
    """Smallest reachable number of each of ``n`` nodes."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a + 1, n):
            if find(a) != find(b) and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [find(x) for x in range(n)]
