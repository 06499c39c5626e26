"""Tokens of two tokenizers aligned by the bytes that they cover.

Tokenizer A is a byte-level BPE of the tokenizers library and encodes space + text, tokenizer B a
sentencepiece BPE and encodes the text, to which it adds the space.  Both give spans: A offsets in
characters, B's proto offsets in bytes.  They are taken as coarse cuts; tokens that share a
character, and pieces of byte fallback, whose spans are empty or cover a whole character, are
refined by the bytes that they decode to.  Where an A token and a B token end at the same byte,
both texts are cut: the tokens between two cuts are a group, the two that end there a link.

Texts are cut into units at places that no token of either vocabulary crosses (:class:`Aligner`),
and each distinct unit is encoded once.  One pass writes the links of every document, a second
counts the pairs, a third adds the counts up by document.  The counted pairs are broadcast only up
to ``PAIRS`` of them; beyond that they are joined.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no
tokens: zeros and an empty digest.  Strings of special tokens are plain text.  Repeated rows and
ids, null ids among them, are documents of their own and count as often as they come.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as T
from . import units
from .shared import release_memory, stored, table, worker_cache

#: Bytes of text aligned at once, units that a worker remembers, pairs that are broadcast.
PIECE = 2 << 20
MEMO = 300_000
PAIRS = 4_000_000
#: Units whose tokens are objects of the two libraries at one time.
TOGETHER = 4_000
#: Split of a byte-level tokenizer file without one of its own: a space goes with the word behind it.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def byte_alphabet() -> dict[str, int]:
    """The byte that every character of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    """A sentencepiece piece in UTF-8, U+2581 as space, ``<0xHH>`` as that byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def pair_code(size_a: int, size_b: int) -> tuple[np.dtype, int]:
    """The type that holds a * factor + b for ids of both vocabularies, and the factor."""
    return np.dtype("<u4" if size_a * size_b <= 1 << 32 else "<i8"), size_b


class Vocabulary:
    """Bytes of every id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.limits = np.concatenate(([0], np.cumsum([len(e) for e in entries]))).astype(np.int64)
        self.sizes = np.diff(self.limits)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[units.ragged(self.limits, ids)[0]]

    def neighbours(self) -> np.ndarray:
        """Whether some entry holds byte x before byte y, as a 256 × 256 table."""
        out = np.zeros((256, 256), dtype=bool)
        inner = np.ones(len(self.data), dtype=bool)
        inner[self.limits[1:-1][self.limits[1:-1] < len(self.data)]] = False
        at = np.flatnonzero(inner)[1:] if len(self.data) else np.zeros(0, np.int64)
        out[self.data[at - 1], self.data[at]] = True
        return out


def spans_to_ends(limits: np.ndarray, begin: np.ndarray, end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens in their texts: the ends of their spans, refined where spans overlap or are empty.

    ``limits``: first token of every text.  A run of tokens whose spans share bytes starts where
    its first span starts; within it the decoded sizes are added up.
    """
    n = len(begin)
    first = np.zeros(n, dtype=bool)
    first[limits[:-1][limits[:-1] < limits[1:]]] = True
    alone = first.copy()
    alone[1:] |= begin[1:] >= end[:-1]
    alone[1:] &= first[1:] | (end[:-1] > begin[:-1])  # an empty span goes on with what follows
    run = np.cumsum(alone) - 1
    starts = np.flatnonzero(alone)
    total = np.concatenate(([0], np.cumsum(sizes)))
    refined = begin[starts][run] + total[1:] - total[starts][run]
    shared = np.bincount(run, minlength=len(starts))[run] > 1 if n else first
    return np.where(shared, refined, end)


class Aligner:
    """Groups and links of texts, unit by unit.

    A text, a space before it, is cut before a space or newline, after a newline that stands alone,
    and between letters, digits and marks, wherever neither vocabulary has an entry with the two
    bytes side by side, so that no merge crosses the cut; A's split cuts there as well.  If a file's
    normalizer or split is another, each text is one unit.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or [])]) + 1
        entries = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            entries[i] = bytes(alphabet[c] for c in token)
        self.bytes_a = Vocabulary(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Vocabulary([b"" if self.b.is_control(i) else piece_bytes(p) for i, p in enumerate(pieces)])
        self.code, self.factor = pair_code(len(self.bytes_a.sizes), len(pieces))
        beside = self.bytes_b.neighbours()
        self.safe = ~beside
        plain = spec.get("normalizer") is None and spec.get("pre_tokenizer") == BYTE_LEVEL and not spec["model"].get("dropout")
        probe = [self.b.encode(t, out_type=str) for t in ("", "a", "a ", "\n")]
        known = probe == [[], ["▁a"], ["▁a", "▁"], ["▁", "<0x0A>"]]
        self.split = bool(plain and known and not beside[10].any() and not beside[:, 10].any() and not beside[33:, 32].any())
        self.memo = units.Memo(MEMO)
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A, tokens of B, groups; -1 where bytes differ
        self.links, self.link_limits = np.zeros(0, self.code), np.zeros(1, np.int64)
        self.digests = pa.array([], pa.large_binary())

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the units of non-empty texts begin."""
        begins = np.zeros(len(data), dtype=bool)
        begins[offsets[:-1]] = True
        if self.split:
            kind = units.classes(data, wide=True)
            solid = kind != units.SPACE
            behind = solid[:-1] & ((data[1:] == 32) | (data[1:] == 10))
            lone = np.zeros(len(data) - 1, dtype=bool)
            lone[1:] = solid[2:] & (data[1:-1] == 10) & solid[:-2]
            begins[1:] |= (behind | lone | units.switches(kind)) & self.safe[data[:-1], data[1:]]
        return np.flatnonzero(begins)

    def spans_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A, limits by text, begins and ends in bytes as its character offsets give them."""
        codes = self.a.encode_batch(texts, add_special_tokens=False)
        limits = np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64)
        ids = np.array([i for c in codes for i in c.ids], dtype=np.int64)
        spans = np.array([s for c in codes for s in c.offsets], dtype=np.int64).reshape(-1, 2)
        data, offsets = T.raw_text(pa.array(texts, pa.string()))
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # the byte where each character begins
        base = np.searchsorted(place, offsets[:-1])
        text = np.repeat(np.arange(len(texts)), np.diff(limits))
        begin, end = (place[spans[:, i] + base[text]] - offsets[text] for i in (0, 1))
        return ids, limits, begin, end

    def spans_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of B, limits by text, begins and ends in bytes of space + text as its proto gives them.

        A unit is encoded behind a newline, whose tokens - the added space and the newline - are
        left out; a whole text without its own first space, which sentencepiece adds.
        """
        lead, own = ("\n", 1) if self.split else ("", 0)
        found = self.b.encode([lead + t[1 - own :] for t in texts], return_type="proto", num_threads=1)
        skip = 2 if self.split else 0
        rows = [[(p.id, p.begin, p.end) for p in proto.pieces] for proto in found]
        limits = np.concatenate(([0], np.cumsum([len(r) - skip for r in rows]))).astype(np.int64)
        flat = np.array([x for r in rows for x in r[skip:]], dtype=np.int64).reshape(-1, 3)
        # Offsets count the bytes given to sentencepiece: a newline, or all but the first space.
        ids, begin, end = flat[:, 0], flat[:, 1] - own, flat[:, 2] - own
        if not self.split:
            begin, end = begin + 1, end + 1
            heads = limits[:-1][limits[:-1] < limits[1:]]
            begin[heads] = 0
        return ids, limits, begin, end

    def _learn(self, new: list[str]) -> None:
        parts = [self._studied(new[a : a + TOGETHER]) for a in range(0, len(new), TOGETHER)]
        counts, links, spelled = zip(*parts, strict=True)
        self.counts = np.concatenate((self.counts, *counts))
        self.links = np.concatenate((self.links, *links))
        self.link_limits = np.concatenate(([0], np.cumsum(np.maximum(self.counts[:, 2], 0))))
        self.digests = pa.concat_arrays([self.digests, *spelled])

    def _studied(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Counts, links and spelled groups of some units."""
        data, offsets = T.raw_text(pa.array(new, pa.string()))
        size = np.diff(offsets)
        sides = []
        for spans, vocabulary in ((self.spans_a, self.bytes_a), (self.spans_b, self.bytes_b)):
            ids, limits, begin, end = spans(new)
            sizes = vocabulary.sizes[ids]
            total = np.concatenate(([0], np.cumsum(sizes)))
            given = np.diff(total[limits]) == size
            spelled, at = vocabulary.spell(ids), total[limits]
            if not (given.all() and np.array_equal(spelled, data)):
                for i in np.flatnonzero(given):
                    given[i] = spelled[at[i] : at[i + 1]].tobytes() == data[offsets[i] : offsets[i + 1]].tobytes()
            sides.append((ids, limits, spans_to_ends(limits, begin, end, sizes), given))
        (ids_a, la, ends_a, ok_a), (ids_b, lb, ends_b, ok_b) = sides
        good = ok_a & ok_b
        span = int(size.max()) + 1
        key_a = np.repeat(np.arange(len(new)), np.diff(la)) * span + ends_a
        key_b = np.repeat(np.arange(len(new)), np.diff(lb)) * span + ends_b
        keep_a, keep_b = np.repeat(good, np.diff(la)), np.repeat(good, np.diff(lb))
        at_a = np.flatnonzero(np.isin(key_a, key_b) & keep_a)
        at_b = np.flatnonzero(np.isin(key_b, key_a) & keep_b)
        groups = np.bincount(key_a[at_a] // span, minlength=len(new))
        links = (ids_a[at_a] * self.factor + ids_b[at_b]).astype(self.code)
        counts = np.where(good[:, None], np.stack([np.diff(la), np.diff(lb), groups], 1), -1)
        spelled = _spelled(ids_a, ids_b, at_a, at_b, np.concatenate(([0], np.cumsum(groups))), la[:-1], lb[:-1], good)
        return counts, links, pa.array(spelled, pa.large_binary())

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of non-empty texts, a space before each: counts of tokens and groups, digests, links and their limits."""
        starts = self.cuts(data, offsets)
        found = units.as_units(data, starts).dictionary_encode()
        number, new = self.memo.number(found.dictionary)
        if new:
            self._learn(new)
        rows = number[found.indices.to_numpy()]
        first = np.searchsorted(starts, offsets)
        bad = np.add.reduceat((self.counts[rows, 0] < 0).astype(np.int64), first[:-1]) > 0
        counts = np.add.reduceat(self.counts[rows], first[:-1], axis=0)
        counts[bad] = 0
        spelled = self.digests.take(pa.array(rows))
        spelled, limits = np.frombuffer(spelled.buffers()[2] or b"", np.uint8), np.frombuffer(spelled.buffers()[1], np.int64)
        digests = ["" if b else hashlib.sha256(spelled[limits[i] : limits[j] - 1]).hexdigest()
                   for i, j, b in zip(first[:-1].tolist(), first[1:].tolist(), bad.tolist(), strict=True)]
        good = np.repeat(~bad, np.diff(first))
        where, limits = units.ragged(self.link_limits, rows[good])
        ends = np.concatenate(([0], np.cumsum(good)))[first]
        out = counts, digests, self.links[where], limits[ends]
        if (left := self.memo.excess()) is not None:
            self.counts, self.link_limits = self.counts[:left].copy(), self.link_limits[: left + 1].copy()
            self.links = self.links[: self.link_limits[-1]].copy()
            self.digests = pa.concat_arrays([self.digests[:left]])
        return out


def _spelled(ids_a, ids_b, at_a, at_b, limits, first_a, first_b, good) -> list[bytes]:
    """Groups of every unit as ``a1,a2|b1;a3|b2,b3;``, nothing for units whose bytes differ."""
    names_a, names_b = [b"%d" % i for i in ids_a.tolist()], [b"%d" % i for i in ids_b.tolist()]
    stops_a, stops_b = (at_a + 1).tolist(), (at_b + 1).tolist()
    out = []
    for g0, g1, a, b, ok in zip(limits[:-1].tolist(), limits[1:].tolist(), first_a.tolist(), first_b.tolist(), good.tolist(), strict=True):
        parts = []
        for g in range(g0, g1) if ok else ():
            parts.append(b",".join(names_a[a : stops_a[g]]) + b"|" + b",".join(names_b[b : stops_b[g]]) + b";")
            a, b = stops_a[g], stops_b[g]
        out.append(b"".join(parts))
    return out


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links) of every row; links: its pairs of ids, one after the other, by ``pair_code``."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        aligner = worker_cache(("align", path_a, path_b), lambda: Aligner(path_a, path_b))
        for batch in batches:
            data, offsets = T.raw_text(batch["text"])
            row, n = 0, batch.num_rows
            while row < n:
                stop = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1))
                own = offsets[row : stop + 1]
                some = np.flatnonzero(np.diff(own))
                sizes = np.zeros((stop - row, 3), np.int64)
                digests, limits, links = [""] * (stop - row), np.zeros(stop - row + 1, np.int64), aligner.links[:0]
                if len(some):
                    spaced = np.insert(data[own[0] : own[-1]], own[:-1][some] - own[0], 32)
                    sizes[some], found, links, ends = aligner(spaced, np.append(own[:-1][some], own[-1]) - own[0] + np.arange(len(some) + 1))
                    for i, digest in zip(some.tolist(), found, strict=True):
                        digests[i] = digest
                    number = np.zeros(stop - row, np.int64)
                    number[some] = np.diff(ends)
                    np.cumsum(number, out=limits[1:])
                binary = pa.Array.from_buffers(pa.binary(), stop - row, [None, pa.py_buffer((limits * links.itemsize).astype(np.int32)), pa.py_buffer(links)])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(row, stop - row), *(pa.array(np.ascontiguousarray(c)) for c in sizes.T), pa.array(digests, pa.string()), binary],
                    ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
                row = stop
        release_memory()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def pair_counts(found: DataFrame, code: np.dtype, factor: int) -> DataFrame:
    """(pair, n, best) of every pair of ids: links that hold it, and whether none of its B id is linked more often."""

    def run(batches):
        for batch in batches:
            links = T.raw_bytes(batch["links"])[0].view(code)
            if len(links):
                seen = pc.value_counts(pa.array(links))
                yield pa.RecordBatch.from_arrays([seen.field(0).cast(pa.int64()), seen.field(1)], ["pair", "n"])

    counted = found.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair") % factor))
    return counted.select("pair", "n", (F.col("n") == most).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", most: int = PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best``: links whose pair no other pair of the same B id exceeds in the corpus;
    ``count_sum``: the corpus counts of a row's links, added up.
    """
    spark = docs.sparkSession
    found = stored(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    known = Aligner(path_a, path_b)
    code, factor = known.code, known.factor
    pairs = stored(pair_counts(found, code, factor), "pairs")
    kind = docs.schema[id_col].dataType.simpleString()
    if pairs.count() <= most:
        rows = pairs.toArrow()
        order = pc.array_sort_indices(rows["pair"].combine_chunks())
        shared = spark.sparkContext.broadcast(tuple(rows[c].combine_chunks().take(order).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

        def run(batches):
            pair, n, best = shared.value
            for batch in batches:
                data, limits = T.raw_bytes(batch["links"])
                named = pa.array(data.view(code)).dictionary_encode()
                at = np.searchsorted(pair, named.dictionary.to_numpy())[named.indices.to_numpy()]
                sums = [np.concatenate(([0], np.cumsum(x)))[limits // code.itemsize] for x in (best[at].astype(np.int64), n[at])]
                columns = [batch[c] for c in ("id", "n_a", "n_b", "n_groups")] + [pa.array(np.diff(limits) // code.itemsize)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.diff(s)) for s in sums), batch["groups_sha256"]],
                                                 [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        fields = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return found.mapInArrow(run, fields)

    numbered = stored(found.withColumn("row", F.monotonically_increasing_id()), "numbered-links")

    def explode(batches):
        for batch in batches:
            for row, links in zip(batch["row"].to_pylist(), batch["links"], strict=True):
                pair, times = np.unique(np.frombuffer(links.as_buffer(), code).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row)), pa.array(pair), pa.array(times)], ["row", "pair", "times"])

    held = numbered.select("row", "links").mapInArrow(explode, "row long, pair long, times long").join(pairs, "pair")
    sums = held.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return numbered.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.expr(f"octet_length(links) div {code.itemsize}").cast("long").alias("n_links"),
        F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """``op12``: byte_bpe_50k as A, piece_bpe_32k as B."""
    import public_tokenizers

    return align(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
