"""Words of whole Arrow text columns as numpy arrays of 64-bit hashes.

A word is a longest run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``.  Hashes are sums of
random byte values times powers of an odd base, so that the hash of every word and of every
run of words is a difference of two running sums; no Python loop touches a byte or a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text that is turned into arrays at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20
MASK = (1 << 64) - 1

_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, from exponent 0 to at least ``n``."""
    if kind not in _powers or len(_powers[kind][0]) <= n:
        size = (int(n) // 65_536 + 2) * 65_536
        base = _BASES[kind]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = np.uint64(b)
            both.append(np.multiply.accumulate(p))
        _powers[kind] = (both[0], both[1])
    return _powers[kind]


def _running(values: np.ndarray, kind: str) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(kind, len(values))[0][: len(values)], out=total[1:])
    return total


@dataclass
class Words:
    """The words of some documents: hashes, byte ranges in ``data``, first word of each document."""

    data: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than documents

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside one document, and the first run of each document."""
        return runs(self.hash, self.first, n)

    def raw(self, i: int, j: int) -> bytes:
        """The bytes from word ``i`` to before word ``j``."""
        return self.data[self.lo[i] : self.hi[j - 1]].tobytes() if j > i else b""


def runs(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total, n_docs = _running(hashes, "word"), len(first) - 1
    per_doc = np.maximum(np.diff(first) - n + 1, 0)
    start = np.zeros(n_docs + 1, dtype=np.int64)
    np.cumsum(per_doc, out=start[1:])
    at = run_starts(first, per_doc, start)
    back = _power("word", len(hashes))[1]
    return mix((total[at + n] - total[at]) * back[at] + np.uint64(n)), start


def run_starts(first: np.ndarray, per_doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every run, the word that it begins with."""
    return np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], per_doc)


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool) -> Words:
    """``data``: UTF-8 of documents, one after the other; ``offsets``: their limits, from 0."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    lo = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    hi = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    total = _running((_FOLDED if fold else _BYTE)[data], "byte")
    back = _power("byte", len(data) + 1)[1]
    return Words(data, lo, hi, mix((total[hi] - total[lo]) * back[lo]), np.searchsorted(lo, offsets).astype(np.int64))


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of a text column without copying; null counts as empty."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    return raw_bytes(column.fill_null("") if column.null_count else column)


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of a text or binary column without nulls and without copying."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, fold: bool, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """The words of a column in pieces of whole documents: first row, row after the last, words."""
    data, offsets = raw_text(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        own = offsets[row : end + 1]
        yield row, end, words_of(data[own[0] : own[-1]], own - own[0], fold)
        row = end


def distinct_per_group(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every group, one after the other, and the limits of the groups."""
    n = len(first) - 1
    group = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((values, group)) if n > 1 else np.argsort(values)
    values, group = values[order], group[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    values, group = values[keep], group[keep]
    return values, np.searchsorted(group, np.arange(n + 1)).astype(np.int64)
