"""Texts cut into units that a tokenizer encodes one by one, so that each distinct unit is encoded once.

A chunk of texts is cut by numpy over its bytes; Arrow's dictionary encoding names the distinct
units, whose results are kept in flat arrays and copied to every place where they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

OTHER, SPACE, LETTER, DIGIT, MARK = range(5)

_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[[b for b in range(33, 127) if chr(b).isalpha()]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = MARK
_WIDE = _CLASS.copy()
_WIDE[28:32] = SPACE


def classes(data: np.ndarray, wide: bool = False) -> np.ndarray:
    """The class of every byte of UTF-8 text.

    Letters are those of ASCII and Latin-1, marks the other printable ASCII characters without
    ``'<|>``, spaces ``\\x20\\x09-\\x0D`` - if ``wide``, also what may be white space elsewhere.
    The rest is other.
    """
    kind = (_WIDE if wide else _CLASS)[data]
    lead = np.flatnonzero(data[:-1] >= 0xC2) if len(data) else np.zeros(0, np.int64)
    first, second = data[lead], data[lead + 1]
    latin = lead[(first == 0xC3) & (second != 0x97) & (second != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    if wide:
        _wide_spaces(data, lead, kind)
    return kind


def _wide_spaces(data: np.ndarray, lead: np.ndarray, kind: np.ndarray) -> None:
    first, second = data[lead], data[lead + 1]
    two = lead[(first == 0xC2) & ((second == 0x85) | (second == 0xA0))]
    kind[two] = kind[two + 1] = SPACE
    wide = (first == 0xE1) & (second == 0x9A) | (first == 0xE2) & ((second == 0x80) | (second == 0x81)) | (first == 0xE3) & (second == 0x80)
    wide = lead[wide]
    wide = wide[wide + 2 < len(data)]
    last, upper = data[wide + 2], data[wide]
    blank = np.where(upper == 0xE2, (last <= 0x8F) | (last == 0x9F) | ((last >= 0xA8) & (last <= 0xAF)), last == 0x80)
    wide = wide[blank]
    kind[wide] = kind[wide + 1] = kind[wide + 2] = SPACE


def switches(kind: np.ndarray) -> np.ndarray:
    """For every byte but the first, whether it and the one before are a letter, a digit or a mark, but not the same of them."""
    return (kind[1:] != kind[:-1]) & (kind[1:] >= LETTER) & (kind[:-1] >= LETTER)


def as_units(data: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    """Pieces of ``data`` that begin at ``starts`` and end where the next begins."""
    limits = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(data)))


def ragged(limits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of ``rows`` lie in the flat array that ``limits`` cuts into rows, and their limits in the result."""
    sizes = limits[rows + 1] - limits[rows]
    out = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(sizes, out=out[1:])
    return np.arange(out[-1]) + np.repeat(limits[rows] - out[:-1], sizes), out


class Memo:
    """Distinct units in the order of their first appearance."""

    def __init__(self, most: int):
        self.most = most
        self.known = pa.array([], pa.string())

    def number(self, units: pa.StringArray) -> tuple[np.ndarray, list[str]]:
        """The number of every unit, and the units that were not known before, which take the next numbers."""
        n = len(self.known)
        joined = pa.concat_arrays([self.known, units]).dictionary_encode()
        self.known = joined.dictionary
        return joined.indices.to_numpy(zero_copy_only=False)[n:], self.known[n:].to_pylist()

    def excess(self) -> int | None:
        """Beyond ``most`` units: how many to keep - the first half, which holds the frequent ones."""
        if len(self.known) <= self.most:
            return None
        self.known = pa.concat_arrays([self.known[: self.most // 2]])
        return self.most // 2
