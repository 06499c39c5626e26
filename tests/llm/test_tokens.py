from __future__ import annotations

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomstat.llm import tokens as K

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = K.Encoder(PATH, 2)


def coded(encoder, *texts):
    """The ids of every text, as the encoder finds them in one chunk."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    flat, limits = encoder(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    return [flat[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)]


def ids(text, end=2):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB \u00e9e\u0301'sΣςİ\x1c\x85\u00a0\u3000  \t\n<|endoftext|>1٣.,!_\U0001f600\ufb01\ud55cÉß×÷", max_size=40), max_size=4))
def test_pieces_as_whole_texts(texts):
    assert coded(ENCODER, *texts) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgotten_units(monkeypatch):
    monkeypatch.setattr(K, "MEMO", 50)
    monkeypatch.setattr(K, "JOINED", 7)
    encoder = K.Encoder(PATH, 2)
    texts = [" ".join(f"word{i * j % 97}, the x{i}" for j in range(40)) for i in range(30)]
    for text in texts:
        assert coded(encoder, text, "", text) == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in (text, "", text)]
        assert len(encoder.memo.known) <= 50 and len(encoder.limits) == len(encoder.memo.known) + 1


@pytest.mark.parametrize("pair", ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a"])
def test_marks_that_compose_with_small_letters_only(pair):
    for text in (pair, f"{pair}adith", f"The Word {pair} <|endoftext|> AND {pair.lower()}X, {pair}Y"):
        assert coded(ENCODER, text)[0] == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["Hello World again", "  two  spaces\n", "It's <|endoftext|> J\u030c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    K.write_shards(docs, str(tmp_path), path, 50256, shards=2)
    for i, text in enumerate(texts):
        assert K.fetch(str(tmp_path), i).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 50256]
    assert K.fetch(str(tmp_path), 0).tolist() == [15496, 2159, 757, 50256]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"cut": True}])
def test_changed_files_encode_whole_texts(tmp_path, change):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert K.by_pieces(spec)
    spec |= {"truncation": {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}} if change.pop("cut", 0) else change
    path = str(tmp_path / "changed.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    text = "Some  Words of a text J\u030c that don't end"
    assert coded(K.Encoder(path, 2), text)[0] == whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.sets(st.text(max_size=6), max_size=300))
def test_perfect_hash(keys):
    hashes = K.key_hash([k.encode() for k in keys])
    found = K.PerfectHash.build(hashes)
    assert sorted(found.slots(hashes).tolist()) == list(range(len(keys)))


def test_perfect_hash_with_unplaced_keys(monkeypatch):
    monkeypatch.setattr(K, "MAX_LEVELS", 1)
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    found = K.PerfectHash.build(hashes)
    assert len(found.unplaced) and sorted(found.slots(hashes).tolist()) == list(range(1000))
    assert (found.slots(hashes + np.uint64(1)) < 1000).all()


@pytest.mark.parametrize("shards", [1, 3])
def test_round_trip(spark, tmp_path, shards):
    rows = [(7, "seven words"), (-3, None), (5, ""), (1, "one <|endoftext|> two"), (10**12, "far " * 3000), (2, "two\n"),
            (2, "two"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    folder = str(tmp_path / "ids")
    manifest = K.write_shards(docs, folder, PATH, 2, shards=shards)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = K.read_shards(spark, folder, with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in order]
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, []).append(ids(t))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids in by_id[r.doc_id]
        by_id[r.doc_id].remove(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert manifest["ids"] == at and manifest["width"] == 2
    assert K.fetch(folder, 1).tolist() == ids("one <|endoftext|> two")
    assert K.fetch(folder, -3).tolist() == [2]
    assert K.fetch(folder, 10**12).tolist() == ids("far " * 3000)
    assert K.fetch(folder, 3) is None and K.fetch(folder, 10**13) is None


def test_fingerprints_refuse_other_keys(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id doc_id", "'a b' text")
    K.write_shards(docs, str(tmp_path), PATH, 2, shards=1)
    shard = K.Shard(str(tmp_path), K.read_manifest(str(tmp_path))["shards"][0]["name"])
    start, count = shard.locate([str(i).encode() for i in range(2000, 12000)])
    assert (start >= 0).sum() == 0 and (count == 0).all()


@pytest.mark.parametrize("n", [1_000, 100_000])
def test_one_document_is_read_in_constant_time(tmp_path, n):
    """The bytes read for a key do not depend on the number of keys."""
    keys, counts = [str(3 * i).encode() for i in range(n)], np.arange(n) % 5 + 1
    with open(tmp_path / "shard", "wb") as out:
        out.write(np.repeat(np.arange(n), counts).astype("<u4").tobytes() + K.index_bytes(keys, counts, 4))
    read = []
    for i in [0, n // 2, n - 1, *range(0, n, n // 50)]:
        shard = K.Shard(str(tmp_path), "shard")
        start, count = shard.find(keys[i])
        assert shard.ids(start, count).tolist() == [i] * counts[i]
        read.append(shard.bytes_read)
    assert np.mean(read) < 700 and max(read) < 1200
    shard = K.Shard(str(tmp_path), "shard")
    starts, sizes = shard.locate(shard.keys())
    assert shard.keys() == keys and sizes.tolist() == counts.tolist() and starts.tolist() == np.cumsum([0, *counts[:-1]]).tolist()


@pytest.mark.parametrize("limits", [{"SHARD_DOCS": 7}, {"SHARD_BYTES": 60}])
def test_shards_are_rolled_and_a_hot_id_is_dealt_out(spark, tmp_path, monkeypatch, limits):
    for name, most in limits.items():
        monkeypatch.setattr(K, name, most)
    monkeypatch.setattr(K, "PIECE", 20)
    rows = [(5, f"word {i} again") for i in range(60)] + [(i, f"text {i}") for i in range(-30, 40)] + [(None, "nothing")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = K.write_shards(docs, str(tmp_path), PATH, 2, shards=4)
    parts = {s["name"].split("-")[1] for s in manifest["shards"]}
    assert len(manifest["shards"]) > 15 and len(parts) == 4 and sum(s["docs"] for s in manifest["shards"]) == len(rows)
    got = K.read_shards(spark, str(tmp_path), with_ids=True).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids(t)) for i, t in rows)
    assert sorted(r.start for r in got) == np.cumsum([0, *(r.n_tokens for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    store = K.Store(str(tmp_path))
    for i in (-30, -1, 0, 4, 6, 39):
        assert store.fetch(i).tolist() == ids(f"text {i}")
    assert store.fetch(5).tolist() in [ids(t) for i, t in rows if i == 5] and store.fetch(-31) is None and store.fetch(99) is None


def test_string_ids_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    K.write_shards(docs, str(tmp_path / "s"), PATH, 2, shards=2)
    assert K.fetch(str(tmp_path / "s"), "a").tolist() == ids("y z")
    assert {r.doc_id for r in K.read_shards(spark, str(tmp_path / "s")).collect()} == {"a", "b"}
    K.write_shards(docs.limit(0), str(tmp_path / "e"), PATH, 2)
    assert K.read_shards(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(ValueError, match="end id"):
        K.write_shards(docs, str(tmp_path / "x"), PATH, 1 << 16)


def test_a_worker_keeps_one_thing():
    from loomstat.llm import shared

    made = []
    make = lambda x: made.append(x) or x
    assert shared.worker_cache("a", lambda: make(1)) == shared.worker_cache("a", lambda: make(2)) == 1
    assert shared.worker_cache("b", lambda: make(3)) == 3
    assert shared.worker_cache("a", lambda: make(4)) == 4
    shared.drop_worker_cache()
    assert made == [1, 3, 4] and shared._cache is None
