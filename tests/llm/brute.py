"""Plain versions of what the operators compute, for small tables."""

from __future__ import annotations


def shingle_set(text: str | None, size: int) -> set:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_groups(docs: list[tuple], size: int, percent: int = 80) -> dict:
    """doc id -> (set size, smallest id reachable); ids are unique and not null."""
    sets = {i: shingle_set(t, size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    ids = sorted(sets)
    for i in ids:
        shared: dict = {}
        for x in sets[i]:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}
