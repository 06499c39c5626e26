"""A log-frequency Bloom filter in segments, and the tally of hashes that fills it.

For every gram the filter holds one event for each quantised level up to the level of its
count; a count is read back by probing level 1, 2, ... until one is missing.  A segment holds
the grams that hash to it, is built in one task and sized by its own events, so the rate of
false positives does not depend on the amount of data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import stored

#: Probes of an event unless an order has its own number, and bits for each probe.
PROBES = 5
#: Probes of levels above the first, at most.
HIGHER = 12
BITS_PER_PROBE = 1.6
#: Share of bits that are set, about, when a segment is built.
FILL = 1 - math.exp(-1 / BITS_PER_PROBE)
#: Probes after which grams that failed are left out.
SIFTED = (0, 1, 3, 7)
#: Frequent grams of an order whose levels, as read once by probes, are kept beside a filter, about.
OFTEN = 1 << 19
#: Largest group of segments that is broadcast at once.
FILTER_BYTES = 128 << 20
#: Beyond it: bytes of the neighbouring segments that one task answers for, about; fewer if bundles would be fewer than the least.
BUNDLE_BYTES = 8 << 20
LEAST_BUNDLES = 32
#: Grams that a bundle answers at once, about.
ANSWERED = 1 << 19


def level(counts: np.ndarray, base: float) -> np.ndarray:
    """1 for a count of 1, one more for every factor ``base``, 0 for none."""
    counts = np.asarray(counts, dtype=np.float64)
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9), 0).astype(np.int64)


class Tally:
    """Counts of hashes in bounded memory: when it is full, they are to be passed on and forgotten."""

    FULL = 1_000_000

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, values: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            values, counts = np.unique(values, return_counts=True)
        self.parts.append((values, counts))
        self.waiting += len(values)

    def full(self) -> bool:
        """Whether more than ``FULL`` distinct hashes wait, about."""
        if self.waiting > 2 * self.FULL:
            self.total()
        return self.waiting > self.FULL

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        found = self.total()
        self.parts, self.waiting = [], 0
        return found

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.parts) > 1:
            values = np.concatenate([p[0] for p in self.parts])
            counts = np.concatenate([p[1] for p in self.parts])
            order = np.argsort(values, kind="stable")
            values, counts = values[order], counts[order]
            start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
            self.parts = [(values[start], np.add.reduceat(counts, start) if len(start) else counts)]
        self.waiting = len(self.parts[0][0])
        return self.parts[0]


HALF = np.uint64(32)


def _draws(grams: np.ndarray, order: int, lvl: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 32-bit draws for a gram and level, which all its probes derive from."""
    x = T.mix(grams + np.uint64((order * 1_000_003 + lvl) * 0x9E3779B97F4A7C15 & T.MASK))
    return x.astype(np.uint32), (x >> HALF).astype(np.uint32) | np.uint32(1)


def _bit(draws: tuple[np.ndarray, np.ndarray], probe: int, size: np.ndarray) -> np.ndarray:
    """Bit of a probe inside a segment of ``size`` bits (fewer than 2**32)."""
    return (((draws[0] + np.uint32(probe) * draws[1]).astype(np.uint64) * size) >> HALF).view(np.int64)


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    return (T.mix(grams ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(segments)).astype(np.int64)


def _probes(own: dict[int, int], order: int, lvl: int) -> int:
    """Probes of an event; a higher level is asked only of grams that passed the first."""
    first = own.get(order, PROBES)
    return first if lvl == 1 else min(first, HIGHER)


def build_segment(counted: dict[int, tuple[np.ndarray, np.ndarray, float]], probes: dict[int, int] | None = None) -> np.ndarray:
    """Bits (as bytes) of one segment: order → (grams, counts, base of the levels).  ``probes``: of orders that have their own number."""
    probes = probes or {}
    levels = {o: level(c, base) for o, (_, c, base) in counted.items()}
    wanted = 0.0
    for o, x in levels.items():
        lowest = int((x > 0).sum())
        wanted += (lowest * _probes(probes, o, 1) + (int(x.sum()) - lowest) * _probes(probes, o, 2)) * BITS_PER_PROBE
    flags = np.zeros(max(8, math.ceil(wanted / 8)) * 8, dtype=bool)
    size = np.uint64(len(flags))
    for order, (grams, *_) in counted.items():
        lvl, left, deep = 1, grams, levels[order]
        while len(left):
            draws = _draws(left, order, lvl)
            for probe in range(_probes(probes, order, lvl)):
                flags[_bit(draws, probe, size)] = True
            lvl += 1
            keep = deep >= lvl
            left, deep = left[keep], deep[keep]
    return np.packbits(flags, bitorder="little")


def slot_shift(slots: int) -> np.uint64:
    """Grams shifted by this are numbers of ``slots`` slots (a power of two, 2 at least)."""
    return np.uint64(64 - (slots.bit_length() - 1))


def often_of(bits: np.ndarray, segment: int, segments: int, counted: dict[int, tuple[np.ndarray, np.ndarray, float]],
             probes: dict[int, int] | None = None) -> bytes:
    """The most frequent grams of a segment, the most frequent last: order, gram and the level that probes read."""
    held, rows = Filter.of(segments, {segment: bits.tobytes()}, probes), []
    for order, (grams, counts, _) in counted.items():
        top = np.argsort(counts, kind="stable")[-(-(-OFTEN // segments)) :]
        row = np.empty(len(top), OFTEN_ROW)
        row["order"], row["gram"], row["level"] = order, grams[top], held.levels(grams[top], order)
        rows.append(row)
    return np.concatenate(rows).tobytes()


#: A frequent gram of a segment.
OFTEN_ROW = np.dtype([("order", np.uint8), ("gram", np.uint64), ("level", np.uint8)])


def often_slots(parts: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By order: grams in slots by their first bits, of those in one slot a frequent one, and their levels.

    What is not held here is probed, so which grams are held changes no level.
    """
    rows, out = np.frombuffer(b"".join(parts), OFTEN_ROW), {}
    for order in np.unique(rows["order"]):
        own = rows[rows["order"] == order]
        grams, levels = own["gram"], own["level"]
        by = np.argsort(levels, kind="stable")
        slots = 1 << max(1, len(grams).bit_length())
        # A gram whose own slot is another: an empty slot matches none.
        known = (~np.arange(slots, dtype=np.uint64)) << slot_shift(slots)
        held = np.zeros(slots, np.uint8)
        place = (grams[by] >> slot_shift(slots)).view(np.int64)
        known[place], held[place] = grams[by], levels[by]
        out[int(order)] = known, held
    return out


@dataclass
class Filter:
    """Some segments of the filter: their bytes in a row, where each begins and how many bits it has."""

    segments: int
    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray  # 0: not held here
    probes: dict[int, int]
    #: Levels of frequent grams of the segments held, by order (see :func:`often_slots`).
    often: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, segments: int, parts: dict[int, bytes], probes: dict[int, int] | None = None, often: list[bytes] | None = None) -> Filter:
        start, size = np.zeros(segments, np.int64), np.zeros(segments, np.uint64)
        rows, at = [], 0
        for s, b in sorted(parts.items()):
            start[s], size[s] = at, len(b) * 8
            rows.append(np.frombuffer(b, np.uint8))
            at += len(b)
        return cls(segments, np.concatenate(rows) if rows else np.zeros(0, np.uint8), start, size, probes or {}, often_slots(often or []))

    def levels(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Levels by repeated probes; 0 for grams that are absent or held by another group of segments."""
        out = np.zeros(len(grams), dtype=np.uint8)
        active = np.arange(len(grams))
        if order in self.often:
            seen, levels = _often(self.often, grams, order)
            out[seen] = levels
            active = np.flatnonzero(~seen)
        segment = segment_of(grams[active], self.segments)
        held = self.size[segment] > 0
        active, segment = active[held], segment[held]
        start, size, grams = self.start[segment], self.size[segment], grams[active]
        lvl = 0
        while len(active) and lvl < 255:
            lvl += 1
            first, second = _draws(grams, order, lvl)
            last, passed = _probes(self.probes, order, lvl) - 1, None
            for probe in range(last + 1):
                at = _bit((first, second), probe, size)
                hit = (self.bits[start + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
                passed = hit if passed is None else passed & hit
                # Most absent grams fail the first probes; what is left then is seldom sifted again.
                if (probe in SIFTED or probe == last) and not passed.all():
                    kept = np.flatnonzero(passed)
                    first, second, active, start, size, grams = (a[kept] for a in (first, second, active, start, size, grams))
                    passed = None
            out[active] = lvl
        return out


def groups_of(built: DataFrame, limit: int) -> list[list[int]]:
    """Segments of a stored filter in groups of at most ``limit`` bytes (a larger segment alone)."""
    groups, room = [], 0
    for segment, size in sorted(map(tuple, built.select("segment", F.length("bits")).collect())):
        if not groups or size > room:
            groups.append([])
            room = limit
        groups[-1].append(segment)
        room -= size
    return groups or [[]]


def shared_group(spark: SparkSession, built: DataFrame, segments: int, group: list[int], probes: dict[int, int] | None = None):
    """One group of segments, broadcast."""
    parts, often = {}, []
    for r in built.where(F.col("segment").isin(group)).toLocalIterator():
        parts[r.segment] = bytes(r.bits)
        often += [bytes(r.often)] if "often" in built.columns else []
    return spark.sparkContext.broadcast(Filter.of(segments, parts, probes, often))


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows``: (id, key, text) and more; stored with the number of the block of about a chunk of text that a row belongs to."""

    def blocked(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            numbers = np.zeros(batch.num_rows, dtype=np.int64)
            for row, end, _ in T.chunks(batch["text"], fold=False):
                numbers[row:end] = block
                block += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], [*rows_columns, "block"])

    rows_columns = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInArrow(blocked, f"{schema}, block long"), "blocks")


def routed(blocks: DataFrame, built: DataFrame, segments: int, ask, probes: dict[int, int] | None = None) -> tuple[DataFrame, object]:
    """(block, n, grams, levels): the grams of every block, sent to bundles of segments and answered there; and a broadcast of the frequent grams' levels.

    The way for filters beyond the broadcast bound.  ``ask`` yields (order, distinct grams) of a
    text column.  Frequent grams are not sent.  A block sends one row per bundle and order, so that rows grow with
    the bytes of the filter and not with its segments; a bundle answers in one task, whose rows are a bounded share of all grams.
    """
    largest = built.agg(F.max(F.length("bits"))).first()[0] or 1
    each = max(1, min(BUNDLE_BYTES // largest, segments // LEAST_BUNDLES))
    bundles = -(-segments // each)
    parts = [bytes(r.often) for r in built.select("often").toLocalIterator()] if "often" in built.columns else []
    often = blocks.sparkSession.sparkContext.broadcast(often_slots(parts))

    def asked(batches):
        for batch in batches:
            numbers = batch["block"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1], [True]))) if len(numbers) else np.zeros(1, int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                for order, grams in ask(batch["text"].slice(a, b - a)):
                    grams = grams[~_often(often.value, grams, order)[0]]
                    own = segment_of(grams, segments) // each
                    own = own.astype(np.uint16) if bundles < 1 << 16 else own
                    sent = np.bincount(own, minlength=bundles)
                    full = np.flatnonzero(sent)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full), pa.array(np.full(len(full), numbers[a])), pa.array(np.full(len(full), order)),
                         _binaries(grams[np.argsort(own, kind="stable")], sent[full])],
                        ["bundle", "block", "n", "grams"])

    def answered(key, left, right):
        parts = right.to_pylist()
        held = Filter.of(segments, {r["segment"]: r["bits"] for r in parts}, probes)
        out = [_answered(rows, held) for batch in left.to_batches() for rows in _some_grams(batch)]
        return pa.Table.from_batches(out, pa.schema([("block", pa.int64()), ("n", pa.int64()), ("grams", pa.binary()), ("levels", pa.binary())]))

    asks = blocks.mapInArrow(asked, "bundle long, block long, n long, grams binary")
    segments_ = built.select(F.floor(F.col("segment") / each).cast("long").alias("bundle"), "segment", "bits")
    return asks.groupBy("bundle").cogroup(segments_.groupBy("bundle")).applyInArrow(
        answered, "block long, n long, grams binary, levels binary"), often


def _binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """``values`` in runs of so many, as bytes."""
    limits = np.concatenate(([0], np.cumsum(lengths))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(limits.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _some_grams(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """A batch in parts of whole rows with at most ``ANSWERED`` grams, or one row."""
    _, limits = T.raw_bytes(batch["grams"])
    out, row = [], 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(limits, limits[row] + 8 * ANSWERED, side="right")) - 1)
        out.append(batch.slice(row, end - row))
        row = end
    return out


def _answered(rows: pa.RecordBatch, held: Filter) -> pa.RecordBatch:
    data, limits = T.raw_bytes(rows["grams"])
    grams, sizes = data.view(np.uint64), np.diff(limits) // 8
    order = np.repeat(rows["n"].to_numpy(), sizes)
    levels = np.empty(len(grams), np.uint8)
    for n in np.unique(order):
        own = order == n
        levels[own] = held.levels(grams[own], int(n))
    return pa.RecordBatch.from_arrays([rows["block"], rows["n"], rows["grams"], _binaries(levels, sizes)], ["block", "n", "grams", "levels"])


def _often(often: dict[int, tuple[np.ndarray, np.ndarray]], grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Which grams are among the frequent ones, and the levels of these."""
    if order not in often:
        return np.zeros(len(grams), bool), np.zeros(0, np.uint8)
    known, levels = often[order]
    place = (grams >> slot_shift(len(known))).view(np.int64)
    seen = known[place] == grams
    return seen, levels[place[seen]]


class Answers:
    """The levels of one block's grams, looked up as in a filter; ``often``: of frequent grams, which were not sent."""

    def __init__(self, rows: pa.Table, often: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.by_order, self.often = {}, often
        for order in (1, 2):
            own = rows.filter(pc.equal(rows["n"], order))
            grams = np.concatenate([np.zeros(0, np.uint64), *(T.raw_bytes(c)[0].view(np.uint64) for c in own["grams"].chunks)])
            levels = np.concatenate([np.zeros(0, np.uint8), *(T.raw_bytes(c)[0] for c in own["levels"].chunks)])
            by = np.argsort(grams)
            self.by_order[order] = grams[by], levels[by]

    def levels(self, grams: np.ndarray, order: int) -> np.ndarray:
        known, levels = self.by_order[order]
        out, (seen, held) = np.empty(len(grams), np.uint8), _often(self.often, grams, order)
        out[seen] = held
        out[~seen] = levels[np.searchsorted(known, grams[~seen])]
        return out
