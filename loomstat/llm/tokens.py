"""Token ids in binary shards with a minimal perfect hash index.

File format of a shard (little-endian), in this order:

* payload: the ids of all documents, in ascending order of their keys, 2 or 4 bytes each;
* per level of the hash: blocks of 72 bytes, the number of bits set before (uint64) and 512 bits;
* per slot: 16 bytes, fingerprint (uint32), number of ids (uint32), first id (uint64);
* hashes of documents that no level could place (uint64) - their slots come last;
* keys in document order: limits (uint64), then their UTF-8 bytes;
* trailer of 64 bytes: magic, bytes per id, documents, ids, levels, unplaced, bytes of keys;
  before it the blocks of each level (uint64).

One document is read in constant time: the trailer, one block for each level that is probed, one slot
and its ids.  The keys serve only to list a shard.

A task begins a new shard after ``SHARD_BYTES`` of ids or ``SHARD_DOCS`` documents.  ``manifest.json``
names the shards, their documents, ids and last keys.  A key is the text of the document's id; the n-th
further row of a shard with the same id has ``\\x00n`` appended, a null id is ``\\x00``.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import struct
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from . import units
from .shared import WholeFile, open_folder, release_memory, shuffle_width, worker_cache

MAGIC = b"LOOMIDS2"
TRAILER = struct.Struct("<8sQQQQQQ8x")
SLOT = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("start", "<u8")])
#: Words of a block of a level, the one with the bits set before it included.
BLOCK = 9
#: Ids and documents of a shard, about.
SHARD_BYTES = 256 << 20
SHARD_DOCS = 1_000_000
#: Bits of a level for each key that reaches it.
GAMMA = 2.0
MAX_LEVELS = 40
#: Text encoded at once, and ids written or checked at once.
PIECE = 4 << 20
#: Units that a worker remembers (about 25 bytes each), and units encoded as one text.
MEMO = 500_000
JOINED = 4_000
#: Units that hold one word, or one word for each digit.
ONE_CLASS = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]+|[!-&(-/:;=?@\[-`{}~]+")
#: Normalizers and splits of tokenizer files that lower-case, drop white space and never join pieces across it.
NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def by_pieces(spec: dict) -> bool:
    """Whether a tokenizer file is known to give a text the ids of its folded pieces, one after the other.

    Normalizer, split and byte level are those listed, added tokens are found before the
    normalizer and are written ``<|name|>``, and a piece always gets the same ids.
    """
    normalizer, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    if normalizer.get("type") != "Sequence" or normalizer.get("normalizers") != list(NORMALIZERS):
        return False
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    known = [[{"type": "Split", "pattern": {"Regex": s}, "behavior": "Removed", "invert": True}, byte_level] for s in SPLITS]
    if split.get("type") != "Sequence" or split.get("pretokenizers") not in known:
        return False
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        return False
    return all(re.fullmatch(r"<\|\w+\|>", t["content"], re.ASCII) and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])
               for t in spec.get("added_tokens") or [])


class Encoder:
    """``tokenizer.encode`` of whole texts; where ``by_pieces`` allows it, unit by unit.

    Then a text is cut at ASCII white space, which yields no ids, and between letters, digits and
    marks (:mod:`units`), where the file's split cuts as well.  A distinct unit is encoded once.
    The ids of an ASCII unit do not depend on its case unless it may name a special token.  Other
    units keep theirs: characters are composed before they are lower-cased, and some marks compose
    with a small letter but not with its capital.  Units of letters, digits or marks alone are
    encoded many at once, since the tokens that end a word tell them apart.  The ids of up to
    ``MEMO`` units are remembered in flat arrays: when there are more, the first half, which holds
    the frequent ones, stays.  With other files no text is cut, folded or remembered.  A file's
    truncation and padding are not applied.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.split = by_pieces(spec)
        self.kind = np.dtype(f"<u{width}")
        self.memo, self.ids, self.limits = units.Memo(MEMO), np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.ends = np.zeros(0, bool)
        suffix = spec["model"].get("end_of_word_suffix")
        if self.split and suffix:
            vocabulary = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(code.ids, self.kind) for a in range(0, len(texts), JOINED)
                for code in self.tokenizer.encode_batch_fast(texts[a : a + JOINED], add_special_tokens=False)]

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of units of one class: they are joined by spaces, the ends of words tell whose an id is."""
        out = []
        for a in range(0, len(texts), JOINED):
            own = texts[a : a + JOINED]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, self.kind)
            words = np.cumsum([len(t) if t[0].isdigit() else 1 for t in own])
            stops = np.flatnonzero(self.ends[ids]) + 1 if not len(ids) or ids.max() < len(self.ends) else ids[:0]
            whole = len(stops) == words[-1] and stops[-1] == len(ids)
            out += np.split(ids, stops[words[:-1] - 1]) if whole else self._whole(own)
        return out

    def _learn(self, new: list[str]) -> None:
        alone = [len(self.ends) == 0 or not ONE_CLASS.fullmatch(t) for t in new]
        coded: list = [None] * len(new)
        for chosen, encode in ((True, self._whole), (False, self._words)):
            at = [i for i, x in enumerate(alone) if x == chosen]
            for i, ids in zip(at, encode([new[i] for i in at]), strict=True):
                coded[i] = ids
        sizes = np.array([len(c) for c in coded], np.int64)
        self.limits = np.concatenate((self.limits, self.limits[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, *coded))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that ``offsets`` cut ``data`` into, one after the other, and the limits of the texts in them."""
        if not self.split:
            coded = self._whole([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.concatenate((self.ids, *coded)), np.concatenate(([0], np.cumsum([len(c) for c in coded], dtype=np.int64)))
        if len(data) == 0:
            return self.ids[:0], np.zeros(len(offsets), np.int64)
        kind = units.classes(data)
        word = kind != units.SPACE
        begins = word.copy()
        begins[1:] &= ~word[:-1] | units.switches(kind)
        edges = offsets[(offsets < len(data))]
        begins[edges] |= word[edges]
        first = np.searchsorted(np.flatnonzero(begins), offsets)
        found = units.as_units(data[word], np.flatnonzero(begins[word])).dictionary_encode()
        distinct = found.dictionary
        low = pc.and_(pc.string_is_ascii(distinct), pc.invert(pc.match_substring(distinct, "<|")))
        number, new = self.memo.number(pc.if_else(low, pc.ascii_lower(distinct), distinct))
        if new:
            self._learn(new)
        where, limits = units.ragged(self.limits, number[found.indices.to_numpy()])
        out = self.ids[where], limits[first]
        if (left := self.memo.excess()) is not None:
            self.limits = self.limits[: left + 1].copy()
            self.ids = self.ids[: self.limits[-1]].copy()
        return out


def encoder_of(path: str, width: int) -> Encoder:
    """The worker's encoder, with what its last task learned."""
    return worker_cache(("tokens", path, width), lambda: Encoder(path, width))


def id_width(path: str) -> int:
    """Bytes that hold every id of the tokenizer file."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def key_hash(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def _place(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (T.mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & T.MASK)) % np.uint64(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    """Levels of bits; a key's slot is the rank of the first bit that is its own (Limasset et al. 2017)."""

    levels: list[np.ndarray]  # uint64 words
    unplaced: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left = [], hashes
        while len(left) and len(levels) < MAX_LEVELS:
            words = 8 * max(1, int(np.ceil(GAMMA * len(left) / 512)))
            at = _place(left, len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def __post_init__(self) -> None:
        counts = [np.bitwise_count(w).astype(np.int64) for w in self.levels]
        before, self.ranks = 0, []
        for c in counts:
            self.ranks.append(before + np.concatenate(([0], np.cumsum(c)[:-1])))
            before += int(c.sum())
        self.placed = before

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of every hash; any slot, or -1, for one that was not built in."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = _place(hashes[left], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
        if len(left) and len(self.unplaced):
            at = np.minimum(np.searchsorted(self.unplaced, hashes[left]), len(self.unplaced) - 1)
            out[left] = np.where(self.unplaced[at] == hashes[left], self.placed + at, -1)
        return out


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (T.mix(hashes ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: list[bytes], counts: np.ndarray, width: int) -> bytes:
    """Everything of a shard that follows its payload."""
    hashes = key_hash(keys)
    found = PerfectHash.build(hashes)
    slots = np.zeros(len(keys), SLOT)
    at = found.slots(hashes)
    slots["fingerprint"][at], slots["count"][at] = fingerprints(hashes), counts
    slots["start"][at] = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(keys) else np.zeros(0)
    blocks = [np.concatenate((r.astype("<u8")[::8, None], w.astype("<u8").reshape(-1, 8)), axis=1) for w, r in zip(found.levels, found.ranks, strict=True)]
    joined = b"".join(keys)
    limits = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype("<u8")
    sizes = np.array([len(b) for b in blocks], dtype="<u8")
    trailer = TRAILER.pack(MAGIC, width, len(keys), int(counts.sum()), len(blocks), len(found.unplaced), len(joined))
    return b"".join([*(b.tobytes() for b in blocks), slots.tobytes(), found.unplaced.astype("<u8").tobytes(), limits.tobytes(), joined, sizes.tobytes(), trailer])


class Shard:
    """One shard, opened: keyed access in constant time, ids read from their place in the file."""

    def __init__(self, folder: str, name: str):
        fs, root = open_folder(folder)
        self.file = fs.open_input_file(posixpath.join(root, name))
        self.bytes_read = 0
        end = self.file.size()
        tail = self._read(max(0, end - TRAILER.size - 8 * MAX_LEVELS), min(end, TRAILER.size + 8 * MAX_LEVELS))
        magic, self.width, self.n, self.n_ids, n_levels, self.n_unplaced, self.n_joined = TRAILER.unpack(tail[-TRAILER.size :])
        if magic != MAGIC:
            raise ValueError(f"{name} is not a shard of token ids")
        before = len(tail) - TRAILER.size
        self.blocks = np.frombuffer(tail[before - 8 * n_levels : before], "<u8").astype(np.int64)
        places = self.n_ids * self.width + 8 * BLOCK * np.concatenate(([0], np.cumsum(self.blocks)))
        self.levels_at, self.slots_at = places[:-1].tolist(), int(places[-1])
        self.unplaced_at = self.slots_at + SLOT.itemsize * self.n
        self.keys_at = self.unplaced_at + 8 * self.n_unplaced

    def _read(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self.file.read_at(size, at)

    def _slot(self, key_hash_: np.ndarray) -> int:
        """The slot of one hash: a block for each level until its own bit is set; -1 if none is."""
        for level, (at, blocks) in enumerate(zip(self.levels_at, self.blocks.tolist(), strict=True)):
            bit = int(_place(key_hash_, level, blocks * 512)[0])
            block = np.frombuffer(self._read(at + 8 * BLOCK * (bit >> 9), 8 * BLOCK), "<u8")
            word, shift = block[1 + (bit >> 6 & 7)], np.uint64(bit & 63)
            if word >> shift & np.uint64(1):
                below = np.bitwise_count(block[1 : 1 + (bit >> 6 & 7)]).sum() + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
                return int(block[0]) + int(below)
        if self.n_unplaced:
            unplaced = np.frombuffer(self._read(self.unplaced_at, 8 * self.n_unplaced), "<u8")
            at = int(np.searchsorted(unplaced, key_hash_[0]))
            if at < len(unplaced) and unplaced[at] == key_hash_[0]:
                return self.n - self.n_unplaced + at
        return -1

    def find(self, key: bytes) -> tuple[int, int]:
        """First id and number of ids of one key; -1 and 0 where the fingerprint says that it is not here."""
        hashes = key_hash([key])
        slot = self._slot(hashes) if self.n else -1
        if slot < 0:
            return -1, 0
        found = np.frombuffer(self._read(self.slots_at + SLOT.itemsize * slot, SLOT.itemsize), SLOT)[0]
        return (int(found["start"]), int(found["count"])) if found["fingerprint"] == fingerprints(hashes)[0] else (-1, 0)

    def keys(self) -> list[bytes]:
        """All keys in document order."""
        raw = self._read(self.keys_at, 8 * (self.n + 1) + self.n_joined)
        limits, joined = np.frombuffer(raw[: 8 * (self.n + 1)], "<u8").astype(np.int64), raw[8 * (self.n + 1) :]
        return [joined[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]

    def locate(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`find` of many keys at once: the whole index is read."""
        raw = self._read(self.n_ids * self.width, self.keys_at - self.n_ids * self.width)
        levels, at = [], 0
        for blocks in self.blocks.tolist():
            levels.append(np.frombuffer(raw, "<u8", blocks * BLOCK, at).reshape(-1, BLOCK)[:, 1:].ravel())
            at += 8 * BLOCK * blocks
        slots = np.frombuffer(raw, SLOT, self.n, at)
        found = PerfectHash(levels, np.frombuffer(raw, "<u8", self.n_unplaced, at + slots.nbytes))
        hashes = key_hash(keys)
        own = found.slots(hashes)
        if not self.n:
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        ok = (own >= 0) & (slots["fingerprint"][own] == fingerprints(hashes))
        return np.where(ok, slots["start"][own].astype(np.int64), -1), np.where(ok, slots["count"][own].astype(np.int64), 0)

    def ids(self, start: int, count: int) -> np.ndarray:
        return np.frombuffer(self._read(start * self.width, count * self.width), f"<u{self.width}").astype("<u4")


def _row_keys(ids: list, last: tuple) -> tuple[list[bytes], tuple]:
    """Keys of rows in ascending order of ids; ``last``: the id before and how often it came."""
    keys = []
    before, times = last
    for i in ids:
        times = times + 1 if i == before else 0
        before = i
        text = b"\x00" if i is None else str(i).encode()
        keys.append(text + (b"\x00%d" % times if times else b""))
    return keys, (before, times)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 shards: int | None = None) -> dict:
    """Encodes every text, appends ``end_id`` and writes shards in ascending order of ids; returns the manifest.

    Any tokenizer file will do; only one that ``by_pieces`` knows is encoded piece by piece.
    Null and empty texts hold the end id alone.  Null ids come first.  Only the two columns are
    read.  An empty table gives a manifest without shards.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer)
    if end_id >= 1 << 8 * width:
        raise ValueError(f"end id {end_id} does not fit {width} bytes")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # A third of all rows may share one id: their texts deal them to several ranges.
    order = ["id", F.xxhash64("text")]
    rows = rows.repartitionByRange(shards or shuffle_width(spark), *order).sortWithinPartitions(*order)
    fields = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("last", pa.binary())])

    def encoded(batches):
        """(keys, counts, ids) of pieces of text, repeated ids numbered from the last shard's start on."""
        encoder = encoder_of(tokenizer, width)
        for batch in batches:
            data, offsets = T.raw_text(batch["text"])
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
                ids, limits = encoder(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
                yield batch["id"].slice(row, stop - row).to_pylist(), np.diff(limits) + 1, np.insert(ids, limits[1:], end_id)
                row = stop

    def write(batches):
        part, number = TaskContext.get().partitionId(), 0
        pieces = encoded(batches)
        piece = next(pieces, None)
        while piece is not None:
            name, keys, counts, last = f"shard-{part:06d}-{number:04d}.ids", [], [], (object(), 0)
            with WholeFile(folder, name) as out:
                while piece is not None and len(keys) < SHARD_DOCS and out.tell() < SHARD_BYTES:
                    new, last = _row_keys(piece[0], last)
                    keys += new
                    counts.append(piece[1])
                    out.write(piece[2].tobytes())
                    piece = next(pieces, None)
                sizes = np.concatenate(counts).astype(np.int64)
                out.write(index_bytes(keys, sizes, width))
            yield pa.RecordBatch.from_pydict({"shard": [part << 32 | number], "name": [name], "docs": [len(keys)], "ids": [int(sizes.sum())], "last": [keys[-1]]}, fields)
            number += 1
        release_memory()

    done = rows.mapInArrow(write, "shard long, name string, docs long, ids long, last binary").collect()
    made, start = [], 0
    for r in sorted(done, key=lambda r: r.shard):
        made.append({"name": r.name, "docs": r.docs, "ids": r.ids, "start": start, "last": bytes(r.last).decode()})
        start += r.ids
    manifest = {"id_type": docs.schema[id_col].dataType.simpleString(), "width": width, "end_id": end_id, "ids": start, "shards": made}
    with WholeFile(folder, "manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, root = open_folder(folder)
    with fs.open_input_file(posixpath.join(root, "manifest.json")) as f:
        return json.loads(f.read())


class Store:
    """The shards of a folder, found by their last keys; the manifest is read once."""

    def __init__(self, folder: str):
        self.folder, self.manifest = folder, read_manifest(folder)
        self.number = self.manifest["id_type"] != "string"
        lowest = float("-inf") if self.number else ""
        self.order = [lowest if s["last"].startswith("\x00") else self._id(s["last"].split("\x00")[0]) for s in self.manifest["shards"]]

    def _id(self, text: str):
        return int(text) if self.number else text

    def fetch(self, key) -> np.ndarray | None:
        """The ids of one document of an integer or string id, or None; of rows that repeat an id, the first.

        One shard, a block for each level that is probed, one slot, one read of ids.
        """
        at = bisect_left(self.order, key)
        if at == len(self.order):
            return None
        shard = Shard(self.folder, self.manifest["shards"][at]["name"])
        start, count = shard.find(str(key).encode())
        return shard.ids(start, count) if start >= 0 else None


def fetch(folder: str, key) -> np.ndarray | None:
    """:meth:`Store.fetch` of a single key."""
    return Store(folder).fetch(key)


def read_shards(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document, found through the index of its shard."""
    manifest = read_manifest(folder)
    shards, n = manifest["shards"], len(manifest["shards"])
    fields = "key string, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches):
        for batch in batches:
            for i in batch["id"].to_pylist():
                shard = Shard(folder, shards[i]["name"])
                keys = shard.keys()
                starts, counts = shard.locate(keys)
                if (counts <= 0).any():
                    raise ValueError(f"{shards[i]['name']}: a key is missing from the index")
                a = 0
                while a < shard.n:  # documents in file order; several in one read
                    b = max(a + 1, int(np.searchsorted(starts, starts[a] + PIECE, side="right")) - 1)
                    b = shard.n if starts[-1] < starts[a] + PIECE else b
                    block = shard.ids(int(starts[a]), int(starts[b - 1] + counts[b - 1] - starts[a]))
                    own = [block[s : s + c] for s, c in zip(starts[a:b] - starts[a], counts[a:b], strict=True)]
                    names = [k.split(b"\x00")[0].decode() if not k.startswith(b"\x00") else None for k in keys[a:b]]
                    columns = [pa.array(names, pa.string()), pa.array(starts[a:b] + shards[i]["start"]), pa.array(counts[a:b]),
                               pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    a = b

    out = spark.range(0, n, 1, max(n, 1)).mapInArrow(read, fields)
    return out.withColumn("key", F.col("key").cast(manifest["id_type"])).withColumnRenamed("key", id_col)


def query(spark, folder: str) -> DataFrame:
    """``op8``: word_bpe_49k with end id 2, written below the shared folder and read back."""
    import public_tokenizers

    from ..session import scratch_path
    from .shared import table

    target = scratch_path(spark, "token-ids")
    write_shards(table(spark, folder, "documents"), target, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_shards(spark, target)
