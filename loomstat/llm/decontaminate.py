"""Benchmark decontamination: test items found in documents with a bounded number of word edits.

An item of m words with an error budget of k is cut into k + 1 pieces.  A stretch of text
within k word insertions, deletions and replacements of the item holds at least one piece
unchanged, so exact hits of pieces give all candidates.  Around every hit, Myers' bit-parallel
algorithm finds the smallest distance of the whole item to any stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .shared import drop_worker_cache, release_memory, stored

#: Errors allowed, as a share of an item's words.
ERRORS = 0.2
#: Words of items that are broadcast at once; more items take more passes over the documents.
PASS_WORDS = 2_000_000
FILTER_BITS = 22


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """Limits of k + 1 pieces of m words, as even as they can be."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def budget(m: int, errors: float) -> int:
    return min(int(m * errors + 1e-9), max(m - 1, 0))


@dataclass
class Item:
    """A test item: its words and, for Myers' algorithm, in which places each word stands."""

    item_id: object
    size: int
    errors: int
    places: dict[int, int]


def search(item: Item, window: list[int]) -> tuple[int, int]:
    """Smallest edit distance of the item to a stretch of ``window``, and where the first such stretch ends."""
    m, top = item.size, 1 << (item.size - 1)
    full = (1 << m) - 1
    plus, minus, score, places = full, 0, m, item.places
    best, best_end = m, 0
    for end, word in enumerate(window, 1):
        eq = places.get(word, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        more = minus | ~(horizontal | plus)
        less = plus & horizontal
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1) & full, (less << 1) & full  # a stretch may begin anywhere: no 1 enters
        plus, minus = (less | ~(vertical | more)) & full, more & vertical
        if score < best:
            best, best_end = score, end
    return best, best_end


class Index:
    """Pieces of some items by length, ready for whole columns of text."""

    def __init__(self, ids: list, bodies: list[str], errors: float = ERRORS):
        self.items: list[Item] = []
        by_length: dict[int, list[tuple[int, int, int]]] = {}  # length → (hash, item, offset)
        for i, words in zip(ids, _hashes(bodies), strict=True):
            m = len(words)
            if not m:
                continue
            k = budget(m, errors)
            places: dict[int, int] = {}
            for j, w in enumerate(words.tolist()):
                places[w] = places.get(w, 0) | 1 << j
            for a, b in pieces(m, k):
                h = int(T.runs(words[a:b], np.array([0, b - a]), b - a)[0][0])
                by_length.setdefault(b - a, []).append((h, len(self.items), a))
            self.items.append(Item(i, m, k, places))
        self.tables = {}
        for length, found in by_length.items():
            found.sort()
            h = np.array([f[0] for f in found], dtype=np.uint64)
            may = np.zeros(1 << FILTER_BITS, dtype=bool)
            may[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables[length] = (h, np.array([f[1] for f in found]), np.array([f[2] for f in found]), may)

    def candidates(self, words: T.Words) -> np.ndarray:
        """Distinct (document, item, word at which the item would begin)."""
        parts = [np.zeros((0, 3), dtype=np.int64)]
        for length, (hashes, item, offset, may) in self.tables.items():
            grams, first = words.runs(length)
            at = np.flatnonzero(may[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(hashes, grams[at], "left"), np.searchsorted(hashes, grams[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            if not len(at):
                continue
            doc = np.searchsorted(first, at, side="right") - 1
            place = at - first[doc]
            entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            parts.append(np.stack([np.repeat(doc, n), item[entry], np.repeat(place, n) - offset[entry]], axis=1))
        return np.unique(np.concatenate(parts), axis=0)

    def matches(self, words: T.Words) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, distance, word after the stretch), the best stretch of each document and item."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for doc, number, begin in self.candidates(words).tolist():
            item = self.items[number]
            first, last = int(words.first[doc]), int(words.first[doc + 1])
            lo = max(first + begin - item.errors, first)
            hi = min(first + begin + item.size + item.errors, last)
            if best.get((doc, number), (item.size, 0))[0] == 0:
                continue  # an exact stretch cannot be bettered
            distance, end = search(item, words.hash[lo:hi].tolist())
            if distance <= item.errors:
                found = (distance, lo + end - first)
                best[doc, number] = min(best.get((doc, number), found), found)
        for (doc, number), (distance, end) in sorted(best.items()):
            yield doc, number, distance, end


def _hashes(bodies: list) -> Iterator[np.ndarray]:
    for _, _, words in T.chunks(pa.array(bodies, pa.string()), fold=True):
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            yield words.hash[a:b]


def indexes(items: DataFrame, id_col: str, text_col: str, errors: float, pass_words: int) -> Iterator[Index]:
    """Items in groups of bounded size, each as an index."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    ids, bodies, held = [], [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        ids.append(r.i)
        bodies.append(r.t)
        held += len(r.t.split())
        if held >= pass_words:
            yield Index(ids, bodies, errors)
            ids, bodies, held = [], [], 0
    yield Index(ids, bodies, errors)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", errors: float = ERRORS, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc id, item id, distance, end): every item found in every document.

    ``distance`` is the smallest number of word edits between the item and a stretch of the
    document (at most ``errors`` times its words, rounded down), ``end`` the number of words
    up to the end of one such stretch.  Words are folded A-Z only.  Null, empty and blank
    items are found nowhere, and such documents hold none.  Repeated rows, also of null ids, are
    rows of their own.  Whole texts are read; other columns are not.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"id {kind}, item string, distance int, end long"

    def passed(index) -> DataFrame:
        def found(batches):
            for batch in batches:
                rows = [(top + d, index.value.items[i].item_id, distance, end)
                        for top, _, words in T.chunks(batch["text"], fold=True)
                        for d, i, distance, end in index.value.matches(words)]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(take), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()),
                     pa.array([r[3] for r in rows], pa.int64())], ["id", "item", "distance", "end"])

        return texts.mapInArrow(found, fields)

    parts = _one_by_one(docs.sparkSession, indexes(items, item_id, item_text, errors, pass_words), passed)
    whole = reduce(DataFrame.union, parts)
    return whole.select(F.col("id").alias(id_col), F.col("item").cast(items.schema[item_id].dataType).alias(item_id), "distance", F.col("end").alias("end_word"))


def _one_by_one(spark: SparkSession, groups: Iterator[Index], passed) -> Iterator[DataFrame]:
    """What ``passed`` returns for every group's broadcast index.

    The last pass is left to the caller's job; every other one is run and stored, and its broadcast
    destroyed, before the next group is broadcast: besides that one, only one more group is in the driver.
    """
    index = next(groups)
    while index is not None:
        following = next(groups, None)
        shared = spark.sparkContext.broadcast(index)
        if following is None:
            yield passed(shared)
        else:
            part = stored(passed(shared), "decontamination")
            shared.destroy()
            yield part
        index = following


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          errors: float = ERRORS, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item; decided row by row without a shuffle."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)
    kept = docs.toDF(*names)

    def passed(index) -> DataFrame:
        def held(batches):
            drop_worker_cache()
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                column = batch[names[at]].cast(pa.string())
                for top, _, words in T.chunks(column, fold=True):
                    keep[[top + m[0] for m in index.value.matches(words)]] = False
                yield batch.filter(pa.array(keep))
            release_memory()

        return kept.mapInArrow(held, kept.schema)

    for part in _one_by_one(docs.sparkSession, indexes(items, item_id, item_text, errors, pass_words), passed):
        kept = part
    return kept.toDF(*docs.columns)


def query(spark, folder: str) -> DataFrame:
    """``op9``: all benchmark items in all documents, with up to a fifth of an item's words edited."""
    from .shared import table

    return find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
