"""Plain single-process versions that the operators are held against."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, fold=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if fold else raw)


def shingles(text, size):
    w = words(text, fold=True)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def linked(a, b, percent):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def near_duplicates(rows, size, percent):
    """[(id, text)] → {id: (n_shingles, component)}; ids distinct."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(sets[i], sets[j], percent):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def kept_words(texts, window):
    """Words of each text outside repeated windows, and how many lie inside."""
    from collections import Counter

    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out
