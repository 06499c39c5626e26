"""Documents packed into token sequences of one length: repeat counts of length combinations by least squares.

A document's whole windows are sequences of their own; what is left of it, its rest, is shorter
than a window.  The histogram of rests has one count per length, however many documents there
are.  All combinations of two or three lengths that fill a window are enumerated, and a
non-negative least-squares fit finds how often to use each, so that together they use up the
histogram.  Counts are rounded up, the largest first, as far as lengths are left.  Residual rests
are packed greedily: longest first, with the longest that fit, as often as this fills a window;
what then remains is laid end to end and cut at window borders, the end of that line at powers of
two, so that nothing is padded.

Each rest is numbered among those of its length: tasks number their own, a window over the counts
of tasks adds those of the tasks before.  Number and length give sequence and offset from a plan
whose size depends on the window only.

Null texts count as empty: they hold the end id alone.  Repeated rows and ids, null ids among them,
are documents of their own; the order of documents within a length is that of the files read.  An
empty table gives no pieces.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from .shared import release_memory, stored, table
from .tokens import PIECE, encoder_of, id_width

#: Steps of the fit, and combinations taken for unused below this repeat count.
STEPS = 150
UNUSED = 1e-6


def shapes(window: int) -> np.ndarray:
    """All two or three lengths in ascending order that add up to ``window``; 0 in place of a third."""
    short = np.arange(1, window // 2 + 1)
    found = [np.stack([short, window - short, np.zeros_like(short)], 1)]
    for a in range(1, window // 3 + 1):
        b = np.arange(a, (window - a) // 2 + 1)
        found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(found)


def repeat_counts(histogram: np.ndarray, found: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative x with A x close to the histogram, A holding how often a shape uses a length.

    Accelerated projected gradient steps; A is never built, products with it are sums over shapes.
    """
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(column, x, size) for column in found.T)
        total[0] = 0
        return total

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[column] for column in found.T)

    if not len(found) or not histogram.any():
        return np.zeros(len(found))
    x = np.ones(len(found))
    for _ in range(15):  # the largest eigenvalue of A'A bounds the step
        x = back(used(x / np.linalg.norm(x)))
    step = 1 / np.linalg.norm(x)
    x = ahead = np.zeros(len(found))
    momentum = 1.0
    for _ in range(steps):
        following = np.maximum(ahead - step * back(used(ahead) - histogram), 0)
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = following + (momentum - 1) / grown * (following - x)
        x, momentum = following, grown
    return x


@dataclass
class Plan:
    """Where the rests of every length go: blocks of them in combinations, the others on a line."""

    window: int
    placed: np.ndarray  # rests of each length that are in blocks
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first rest, copies, first sequence, offset
    sequences: int = 0
    table: np.ndarray | None = None  # the rows in order, once the plan is closed
    line: np.ndarray | None = None  # where the line holds the rests of each length
    line_from: int = 0
    borders: np.ndarray | None = None  # of the line's end, after its last whole window

    def use(self, counts: list[tuple[int, int]], times: int) -> None:
        """``times`` sequences of ``counts``: (length, copies)."""
        offset = 0
        for length, copies in counts:
            self.rows.append((length, int(self.placed[length]), copies, self.sequences, offset))
            self.placed[length] += copies * times
            offset += length * copies
        self.sequences += times

    def close(self, left: np.ndarray, bare: bool) -> None:
        """What is left goes to the line; with ``bare``, its end is cut into powers of two, the largest first."""
        tokens = left * np.arange(len(left))
        self.line = np.concatenate(([0], np.cumsum(tokens)[:-1]))
        total = int(tokens.sum())
        whole, end = divmod(total, self.window)
        self.line_from = self.sequences
        sizes = [1 << b for b in reversed(range(end.bit_length())) if end >> b & 1] if bare else [end] * (end > 0)
        self.borders = whole * self.window + np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int64)
        self.sequences += whole + len(sizes)
        self.table, self.rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5), []

    def pieces(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of rests, by length and number: (rest, start in the rest, length, sequence, offset) of their pieces, rest by rest."""
        key = self.table[:, 0] << 44 | self.table[:, 1]
        row = np.searchsorted(key, length << 44 | number, side="right") - 1
        inside = number < self.placed[length]
        at = np.flatnonzero(inside)
        _, first, copies, sequence, offset = self.table[row[at]].T
        nth = number[at] - first
        out = [(at, np.zeros_like(at), length[at], sequence + nth // copies, offset + nth % copies * length[at])]
        at = np.flatnonzero(~inside)
        here = self.line[length[at]] + (number[at] - self.placed[length[at]]) * length[at]
        begin, stop = here, here + length[at]
        while len(at):
            tail = np.searchsorted(self.borders, here, side="right") - 1
            whole = tail < 0
            low = np.where(whole, here // self.window * self.window, self.borders[tail])
            high = np.where(whole, low + self.window, self.borders[np.minimum(tail + 1, len(self.borders) - 1)])
            sequence = self.line_from + np.where(whole, here // self.window, self.borders[0] // self.window + tail)
            end = np.minimum(high, stop)
            out.append((at, here - begin, end - here, sequence, here - low))
            more = end < stop
            at, here, begin, stop = at[more], end[more], begin[more], stop[more]
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        order = np.lexsort((columns[1], columns[0]))
        return tuple(c[order] for c in columns)


def make_plan(histogram: np.ndarray, window: int, bare: bool = True) -> Plan:
    """The plan for rests whose counts by length, from 0, are ``histogram``."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan = Plan(window, np.zeros(window, dtype=np.int64))
    found = shapes(window)
    x = repeat_counts(left.astype(float), found)
    order = np.argsort(-x, kind="stable")
    order = order[x[order] > UNUSED]
    have = left.tolist()
    for (a, b, c), wanted in zip(found[order].tolist(), np.ceil(x[order] - UNUSED).astype(np.int64).tolist(), strict=True):
        counts: dict[int, int] = {}
        for length in (a, b, c) if c else (a, b):
            counts[length] = counts.get(length, 0) + 1
        times = min(wanted, *(have[length] // n for length, n in counts.items()))
        if times > 0:
            plan.use(list(counts.items()), times)
            for length, n in counts.items():
                have[length] -= n * times
    left = np.array(have, dtype=np.int64)
    _greedy(plan, left)
    plan.close(left, bare)
    return plan


def _greedy(plan: Plan, left: np.ndarray) -> None:
    """Fills windows exactly: the longest rest, then the longest that fit, as often as their counts allow."""
    first = len(left) - 1
    while True:
        have = np.flatnonzero(left[: first + 1])
        if not len(have):
            return
        first = int(have[-1])
        counts, gap, limit = [(first, 1)], plan.window - first, first
        while gap:
            fits = have[have <= min(gap, limit)]
            if not len(fits):
                break
            length = int(fits[-1])
            taken = 1 if length == first else 0
            copies = min(gap // length, int(left[length]) - taken)
            if copies:
                counts.append((length, copies))
                gap -= copies * length
            limit = length - 1
        if gap:
            first -= 1  # no whole window from here: these go to the line
            continue
        uses: dict[int, int] = {}
        for length, copies in counts:
            uses[length] = uses.get(length, 0) + copies
        times = min(int(left[length]) // n for length, n in uses.items())
        plan.use(list(uses.items()), times)
        for length, n in uses.items():
            left[length] -= n * times


def encode(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every document and, within the task that made them, its number among rests of its length.

    (id, part, rest, nth, whole, n_tokens, ids): ``nth`` counts the earlier rests of that length in
    the part, ``whole`` the earlier whole windows of documents with such rests.
    """
    width = id_width(tokenizer)
    if end_id >= 1 << 8 * width:
        raise ValueError(f"end id {end_id} does not fit {width} bytes")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        encoder, part = encoder_of(tokenizer, width), TaskContext.get().partitionId()
        seen, seen_whole = np.zeros(window, np.int64), np.zeros(window, np.int64)
        for batch in batches:
            data, offsets = T.raw_text(batch["text"])
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
                ids, limits = encoder(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
                ids = np.insert(ids, limits[1:], end_id)
                limits = limits + np.arange(len(limits))
                sizes = np.diff(limits)
                rest, whole = sizes % window, sizes // window
                order = np.argsort(rest, kind="stable")
                starts = np.searchsorted(rest[order], np.arange(window))
                nth, before = np.empty_like(rest), np.empty_like(rest)
                sums = np.concatenate(([0], np.cumsum(whole[order])))
                nth[order] = seen[rest[order]] + np.arange(len(order)) - starts[rest[order]]
                before[order] = seen_whole[rest[order]] + sums[:-1] - sums[starts[rest[order]]]
                seen += np.bincount(rest, minlength=window)
                seen_whole += np.bincount(rest, whole, window).astype(np.int64)
                binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((limits * width).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(row, stop - row), pa.array(np.full(len(sizes), part, np.int32)), pa.array(rest.astype(np.int32)),
                     pa.array(nth), pa.array(before), pa.array(sizes), binary], ["id", "part", "rest", "nth", "whole", "n_tokens", "ids"])
                row = stop
        release_memory()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, part int, rest int, nth long, whole long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, bare: bool = True, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every document.

    Every sequence holds ``window`` tokens but those at the end of the line: powers of two with
    ``bare``, otherwise one that needs padding.  Only the 2048 counts by length pass through the driver.
    """
    spark, width = docs.sparkSession, id_width(tokenizer)
    encoded = stored(encode(docs, tokenizer, end_id, window, id_col, text_col), "encoded")
    counts = encoded.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("rests"), F.sum(F.expr(f"n_tokens div {window}")).alias("wholes"))
    counts = stored(counts, "rests")
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("rest", "part", F.coalesce(F.sum("rests").over(before), F.lit(0)).alias("rests_before"),
                         F.coalesce(F.sum("wholes").over(before), F.lit(0)).alias("wholes_before"))
    histogram, wholes = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("rests").alias("rests"), F.sum("wholes").alias("wholes")).collect():
        histogram[r.rest], wholes[r.rest] = r.rests, r.wholes
    plan = make_plan(histogram, window, bare)
    wholes_from = plan.sequences + np.concatenate(([0], np.cumsum(wholes)[:-1]))
    shared = spark.sparkContext.broadcast((plan, wholes_from))
    rows = encoded.join(base, ["part", "rest"]).select(
        "id", "rest", "n_tokens", "ids", (F.col("nth") + F.col("rests_before")).alias("number"),
        (F.col("whole") + F.col("wholes_before")).alias("window"))

    def run(batches):
        plan, wholes_from = shared.value
        for batch in batches:
            rest, n, number = (batch[c].to_numpy().astype(np.int64) for c in ("rest", "n_tokens", "number"))
            own = n // window
            first = wholes_from[rest] + batch["window"].to_numpy()
            doc = np.repeat(np.arange(len(n)), own)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
            parts = [(doc, nth * window, np.full(len(doc), window), first[doc] + nth, np.zeros(len(doc), np.int64))]
            some = np.flatnonzero(rest)
            at, start, length, sequence, offset = plan.pieces(rest[some], number[some])
            parts.append((some[at], start + own[some[at]] * window, length, sequence, offset))
            doc, start, length, sequence, offset = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((start, doc))
            doc, start, length, sequence, offset = (c[order] for c in (doc, start, length, sequence, offset))
            data, limits = T.raw_bytes(batch["ids"])
            flat = data.view(f"<u{width}").astype("<u4")
            low = limits[doc] // width + start
            own_ids = [flat[a:b] for a, b in zip(low.tolist(), (low + length).tolist(), strict=True)]
            columns = [batch["id"].take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own_ids], pa.int64()),
                       pa.array(n[doc]), pa.array(sequence), pa.array(offset)]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in own_ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(run, fields + ", ids array<int>" * with_ids)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """``op11``: word_bpe_49k with end id 1, windows of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
