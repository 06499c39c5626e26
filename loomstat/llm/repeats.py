"""Removal of repeated passages by prefix-partitioned suffix trees.

A passage repeats if ``window`` consecutive words of a document also start anywhere else.

1. Sampling of suffixes.  Of the runs of ``prefix`` words inside a window the one with the
   smallest hash (the first of equals) is its anchor.  Equal windows have equal anchors at the
   same place, so only suffixes at anchors need a prefix: about one word in fifteen.
2. Prefix counts.  Anchors whose prefix occurs once are leaves of the suffix tree and end here.
   The counts of the others go into a log-frequency Bloom filter, which is broadcast up to a bounded
   size; beyond it anchors ask its segments.  What it lets through wrongly only costs work.
3. Partition.  The words around the remaining anchors are dealt by prefix into groups that fit
   a task.  A prefix that is too frequent for that is extended to the whole window, whose
   subtree is a single deep node: there, a count says whether it is internal.
4. Subtrees.  Each group sorts its suffixes (prefix doubling) and takes the longest common
   prefixes of neighbours; internal nodes at least ``window`` deep are repeats.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .bloom import FILTER_BYTES, Answers, Tally, build_segment, groups_of, in_blocks, routed, segment_of, shared_group
from .shared import stored

#: Suffixes of one group, about, and the level from which a prefix is extended (2 ** 10 anchors).
GROUP = 6_000
HOT_LEVEL = 11
SEGMENT_KEYS = 500_000
LEAST_GROUPS = 48
#: Bits that hold a word's place beside its hash.
PLACE = np.uint64((1 << 28) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every ``width`` neighbours, in log2(width) passes."""
    if len(values) < width:
        return values[:0]
    low, span = values, 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - span : width - span + n])


def anchors(words: T.Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, place of the anchor (as words), prefix hash."""
    grams, first = words.runs(prefix)
    n_windows = np.maximum(words.counts - window + 1, 0)
    start = np.concatenate(([0], np.cumsum(n_windows)))
    if not start[-1]:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_min(packed, window - prefix + 1)
    at = (low[T.run_starts(first, n_windows, start)] & PLACE).astype(np.int64)  # as grams
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(edge[1:], len(at)) - 1
    window_word = T.run_starts(words.first, n_windows, start)
    gram_word = T.run_starts(words.first, np.diff(first), first)
    return window_word[edge], window_word[last], gram_word[at[edge]], grams[at[edge]]


def repeated_depth(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every word of some pieces: the longest prefix its suffix shares with another suffix of the group.

    Suffixes end with their piece.  Ranks of prefixes of 1, 2, 4, ... words give the sorted order;
    neighbours in it are compared by the same ranks from long to short.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))
    ranks = [np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1]  # 0: beyond the piece
    span, longest = 1, int(np.diff(first).max())
    here = np.arange(n)

    def ahead(rank, by):
        to = here + by
        return np.where(to < end, rank[np.minimum(to, n - 1)], 0)

    while span < longest:
        both = ranks[-1] * np.int64(n + 2) + ahead(ranks[-1], span)
        ranks.append(np.unique(both, return_inverse=True)[1].astype(np.int64) + 1)
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    depth = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        inside = (a + depth + step <= end[order[:-1]]) & (b + depth + step <= end[order[1:]])
        at = np.minimum(a + depth, n - 1), np.minimum(b + depth, n - 1)
        same = inside & (ranks[level][at[0]] == ranks[level][at[1]])
        depth += np.where(same, step, 0)
    out = np.zeros(n, dtype=np.int64)
    np.maximum.at(out, order[:-1], depth)
    np.maximum.at(out, order[1:], depth)
    return out


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in any [start, end)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Limits of the runs of true places."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _repeated_prefixes(texts: DataFrame, window: int, prefix: int, hot_level: int) -> tuple[DataFrame, int, int, int]:
    """Filter of the prefixes of at least two anchors, its number of segments, the anchors they have, and those of hot ones."""

    def counted(batches):
        tally = Tally()

        def passed():
            key, count = tally.take()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], ["key", "n"])

        for batch in batches:
            for _, _, words in T.chunks(batch["text"], fold=False):
                tally.add(anchors(words, window, prefix)[3])  # an anchor is a run of windows, so each is met once
                if tally.full():
                    yield passed()
        yield passed()

    keys = texts.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    keys = stored(keys, "prefixes")
    hot = F.sum(F.when(F.col("n") >= 1 << (hot_level - 1), F.col("n")))
    n_keys, n_anchors, n_hot = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(hot, F.lit(0))).first()
    segments = max(LEAST_GROUPS, -(-n_keys // SEGMENT_KEYS))

    def placed(batches):
        for batch in batches:
            key = batch["key"].to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(key, segments)), batch["key"], batch["n"]], ["segment", "key", "n"])

    def build(key, group):
        grams, n = group["key"].to_numpy().view(np.uint64), group["n"].to_numpy()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()),
                         "bits": pa.array([build_segment({1: (grams, n, 2.0)}).tobytes()], pa.binary())})

    built = keys.mapInArrow(placed, "segment long, key long, n long").groupBy("segment").applyInArrow(
        build, "segment long, bits binary")
    return stored(built, "prefix-filter"), segments, n_anchors, n_hot


def _hot_spans(pieces: DataFrame, window: int, n_hot: int, id_type: str, limit: int) -> list[DataFrame]:
    """Spans of the windows that occur twice or more around hot prefixes; ``pieces``: (id, key, lo, windows).

    A window is a prefix of full length here, so its subtree is one node and its group one count.
    Tasks add up their own windows first and pass them on as arrays, one for each segment of the
    hashes.  The repeated ones come back in groups of segments of bounded size.
    """
    segments = max(LEAST_GROUPS, -(-n_hot * window // SEGMENT_KEYS))

    def counted(batches):
        tally = Tally()

        def passed():
            whole, n = tally.take()
            own = segment_of(whole, segments)
            by = np.argsort(own, kind="stable")
            whole, n, limits = whole[by], np.minimum(n[by], 2).astype(np.uint8), np.searchsorted(own[by], np.arange(segments + 1))
            full = np.flatnonzero(np.diff(limits))
            cut = lambda a: pa.array([a[limits[x] : limits[x + 1]].tobytes() for x in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full), cut(whole), cut(n)], ["segment", "whole", "n"])

        for batch in batches:
            tally.add(batch["windows"].flatten().to_numpy().view(np.uint64))
            if tally.full():
                yield passed()
        yield passed()

    def repeated(key, group):
        tally = Tally()
        for whole, n in zip(group["whole"].to_pylist(), group["n"].to_pylist(), strict=True):
            tally.add(np.frombuffer(whole, np.uint64), np.frombuffer(n, np.uint8).astype(np.int64))
        whole, n = tally.total()
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([whole[n > 1].tobytes()], pa.binary())})

    parts = pieces.select("windows").mapInArrow(counted, "segment long, whole binary, n binary")
    twice = stored(parts.groupBy("segment").applyInArrow(repeated, "segment long, bits binary"), "windows")
    found = []
    for group in groups_of(twice, limit):
        rows = twice.where(F.col("segment").isin(group)).toLocalIterator()
        held = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r.bits), np.uint64) for r in rows)]))
        shared = pieces.sparkSession.sparkContext.broadcast(held)

        def marked(batches, shared=shared):
            for batch in batches:
                whole = batch["windows"].flatten().to_numpy().view(np.uint64)
                at = np.minimum(np.searchsorted(shared.value, whole), max(len(shared.value) - 1, 0))
                hit = shared.value[at] == whole if len(shared.value) else np.zeros(len(whole), bool)
                limits = np.concatenate(([0], np.cumsum(batch["windows"].value_lengths().to_numpy())))
                # Runs of repeated windows, cut where a piece ends.
                edge = np.concatenate(([True], hit[1:] != hit[:-1], [True])) if len(hit) else np.ones(1, bool)
                edge[limits] = True
                cuts = np.flatnonzero(edge)
                begin, end = cuts[:-1][hit[cuts[:-1]]], cuts[1:][hit[cuts[:-1]]]
                own = np.searchsorted(limits, begin, side="right") - 1
                base = batch["lo"].to_numpy()[own] - limits[own]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(take), batch["key"].take(take), pa.array(begin + base), pa.array(end + base + window - 1)],
                    ["id", "key", "lo", "hi"])

        found.append(pieces.mapInArrow(marked, f"id {id_type}, key long, lo long, hi long"))
    return found

def _pieces(batch: pa.RecordBatch, held, window: int, prefix: int, hot_level: int):
    """The words around the anchors whose prefixes occur twice or more; for hot prefixes the windows instead."""
    for top, _, words in T.chunks(batch["text"], fold=False):
        i0, i1, _, key = anchors(words, window, prefix)
        lvl = held.levels(key, 1)
        keep = np.flatnonzero(lvl > 0)
        if not len(keep):
            continue
        i0, i1, key, lvl = i0[keep], i1[keep], key[keep], lvl[keep]
        doc = np.searchsorted(words.first, i0, side="right") - 1
        whole, limits = words.runs(window)
        whole, at = whole.view(np.int64), limits[doc] + i0 - words.first[doc]
        hot = lvl >= hot_level
        take = pa.array(top + doc)
        yield pa.RecordBatch.from_arrays(
            [batch["id"].take(take), batch["key"].take(take), pa.array(key.view(np.int64)), pa.array(i0 - words.first[doc]),
             pa.array([None if h else words.raw(a, b + window) for h, a, b in zip(hot, i0, i1, strict=True)], pa.binary()),
             pa.array([whole[a : a + n] if h else None for h, a, n in zip(hot, at, i1 - i0 + 1, strict=True)], pa.list_(pa.int64()))],
            ["id", "key", "prefix", "lo", "body", "windows"])


def repeated_spans(texts: DataFrame, window: int, prefix: int, filter_bytes: int = FILTER_BYTES,
                   hot_level: int = HOT_LEVEL) -> DataFrame:
    """``texts``: (id, key, text); returns (id, key, lo, hi): words lo to before hi lie in repeats."""
    spark = texts.sparkSession
    id_type = texts.schema["id"].dataType.simpleString()
    built, segments, n_anchors, n_hot = _repeated_prefixes(texts, window, prefix, hot_level)
    groups = max(LEAST_GROUPS, -(-n_anchors // GROUP))
    schema = f"id {id_type}, key long, prefix long, lo long, body binary, windows array<long>"
    parts = groups_of(built, filter_bytes)
    if len(parts) == 1:
        shared = shared_group(spark, built, segments, parts[0])

        def pieces(batches):
            for batch in batches:
                yield from _pieces(batch, shared.value, window, prefix, hot_level)

        around = stored(texts.mapInArrow(pieces, schema), "pieces")
        shared.destroy()
    else:
        blocks = in_blocks(texts)

        def asked(column):
            for _, _, words in T.chunks(column, fold=False):
                yield 1, np.unique(anchors(words, window, prefix)[3])

        def block_pieces(left: pa.Table, right: pa.Table) -> pa.Table:
            held = Answers(right, often.value)
            found = [p for b in left.combine_chunks().to_batches() for p in _pieces(b, held, window, prefix, hot_level)]
            empty = pa.schema([("id", left.schema.field("id").type), ("key", pa.int64()), ("prefix", pa.int64()), ("lo", pa.int64()),
                               ("body", pa.binary()), ("windows", pa.list_(pa.int64()))])
            return pa.Table.from_batches(found) if found else empty.empty_table()

        answers, often = routed(blocks, built, segments, asked)
        around = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(block_pieces, schema), "pieces")
        often.destroy()

    def subtree(group: pa.Table) -> pa.Table:
        data, offsets = T.raw_text(group["body"].combine_chunks().cast(pa.string()))
        words = T.words_of(data, offsets, fold=False)
        depth = repeated_depth(words.hash, words.first)
        at = np.flatnonzero(depth >= window)
        piece = np.searchsorted(words.first, at, side="right") - 1
        lo, hi = spans(covered(at, at + depth[at], len(words.hash)))
        # Spans of neighbouring pieces can touch: cut them at the pieces.
        cut = words.first[np.unique(piece)]
        edges = np.unique(np.concatenate([lo, hi, cut, words.first[np.unique(piece) + 1]])) if len(lo) else np.zeros(0, np.int64)
        inside = covered(lo, hi, len(words.hash))
        pairs = [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if inside[a]] if len(edges) else []
        begin = np.array([p[0] for p in pairs], dtype=np.int64)
        end = np.array([p[1] for p in pairs], dtype=np.int64)
        own = np.searchsorted(words.first, begin, side="right") - 1
        base = group["lo"].to_numpy()[own] - words.first[own]
        take = pa.array(own)
        return pa.table({"id": group["id"].take(take), "key": group["key"].take(take),
                         "lo": pa.array(begin + base, pa.int64()), "hi": pa.array(end + base, pa.int64())})

    cold = around.where("body is not null").withColumn("part", F.pmod(F.xxhash64("prefix"), F.lit(groups)))
    cold = cold.select("part", "id", "key", "lo", "body").groupBy("part")
    found = [cold.applyInArrow(subtree, f"id {id_type}, key long, lo long, hi long")]
    found += _hot_spans(around.where("windows is not null").select("id", "key", "lo", "windows"), window, n_hot, id_type, filter_bytes)
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    return whole


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, prefix: int = 8,
                   filter_bytes: int = FILTER_BYTES, hot_level: int = HOT_LEVEL) -> DataFrame:
    """(id, n_words, n_removed, kept): the words outside repeats, joined by one space.

    Every occurrence of a repeat is removed, the first one too.  Repeats are judged on the
    input.  Null, empty and blank texts have no words and keep an empty text; shorter texts than
    a window stay whole.  Rows may repeat ids, also null ones: equal rows repeat each other.
    Whole texts are read; other columns are not.
    """
    if not 0 < prefix <= window:
        raise ValueError("a prefix holds at least one word and no more than a window")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("key"), body.alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    found = repeated_spans(texts, window, prefix, filter_bytes, hot_level)
    found = found.groupBy("id", "key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    found = stored(found, "spans").toDF("span_id", "span_key", "lo", "hi")
    both = texts.join(found, F.col("id").eqNullSafe(F.col("span_id")) & (F.col("key") == F.col("span_key")), "left")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            los, his = batch["lo"], batch["hi"]
            for top, end, words in T.chunks(batch["text"], fold=False):
                gone = np.zeros(len(words.hash), dtype=bool)
                for d in range(end - top):
                    a, b = words.first[d], words.first[d + 1]
                    if los[top + d].is_valid:
                        gone[a:b] = covered(los[top + d].values.to_numpy(), his[top + d].values.to_numpy(), b - a)
                    n_words.append(int(b - a))
                    n_removed.append(int(gone[a:b].sum()))
                    rest = b" ".join([words.raw(x, y) for x, y in zip(*(p + a for p in spans(~gone[a:b])), strict=True)])
                    kept.append(b" ".join(rest.split()))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["id", "n_words", "n_removed", "kept"])

    out = both.select("id", "text", "lo", "hi").mapInArrow(cut, f"id {id_type}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def query(spark, folder: str) -> DataFrame:
    """``op10``: windows of 35 words over every document."""
    from .shared import table

    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
