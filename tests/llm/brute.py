"""What the operators should find, by plain loops."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def groups(pairs, nodes) -> dict:
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_pairs(docs: dict[int, str | None], similarity: float = 0.8):
    """Pairs of ids whose multisets of runs of five words overlap enough."""
    sets = {}
    for i, text in docs.items():
        w = words(text)
        sets[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    by_run = defaultdict(list)
    for b, runs in sets.items():
        shared = Counter()
        for run, n in runs.items():
            for a, m in by_run[run]:
                shared[a] += min(n, m)
            by_run[run].append((b, n))
        for a, n in shared.items():
            if n / (sets[a].total() + runs.total() - n) >= similarity:
                yield a, b


def without_repeats(rows: list[tuple[int, str | None]], window: int = 50) -> list[tuple[int, int, list[bytes]]]:
    """(words, removed, kept words) of each row."""
    first: dict = {}
    for i, text in rows:
        w = words(text)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    found = []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        found.append((len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return found


def without_boilerplate(rows, ratio: float, least: int, distinct: bool = False) -> list[str | None]:
    """Texts of (host, text) rows without the lines that too many of their host's have."""
    counted = list(dict.fromkeys(rows)) if distinct else rows
    pages, on = Counter(h for h, _ in counted), Counter()
    for host, text in counted:
        on.update((host, line) for line in {x.strip(" ") for x in (text or "").split("\n")} - {""} if text is not None)
    bad = {key for key, n in on.items() if n >= least and n > pages[key[0]] * ratio}
    return [
        None if text is None else "\n".join(x for x in text.split("\n") if (host, x.strip(" ")) not in bad) for host, text in rows
    ]
