from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomstat.llm import packing as P
from loomstat.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def power(n):
    return n & (n - 1) == 0


def check(rows, documents, window, end=1):
    """``documents``: [(id, text)]; every id lies in one piece, sequences have no gaps and no padding."""
    wanted = sorted((str(i), tuple([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, end])) for i, t in documents)
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
        assert r.length > 0 and r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or at < window and power(at)
    assert sorted(sequences) == list(range(len(sequences)))
    got = []
    for i, pieces in by_doc.items():
        left = sorted(pieces, key=lambda r: r.start)
        while left:  # documents with the same id: any pieces that follow each other
            ids, total = [], left[0].doc_tokens
            while len(ids) < total:
                r = next(r for r in left if r.start == len(ids) and r.doc_tokens == total)
                left.remove(r)
                ids += r.ids
            got.append((str(i), tuple(ids)))
    assert sorted(got) == wanted
    return len(rows), len(sequences)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=200), st.booleans())
def test_plans(lengths, bare):
    histogram = np.bincount(lengths, minlength=32)
    plan = P.make_plan(histogram, 32, bare)
    length = np.repeat(np.arange(32), histogram)
    number = np.concatenate([np.arange(n) for n in histogram]).astype(np.int64)
    rest, start, size, sequence, offset = plan.pieces(length, number)
    taken = np.bincount(rest, size, len(length))
    assert taken.tolist() == length.tolist()
    for i in range(len(length)):
        own = rest == i
        assert start[own].tolist() == np.cumsum([0, *size[own][:-1]]).tolist()
    fill = defaultdict(list)
    for q, o, n in zip(sequence.tolist(), offset.tolist(), size.tolist(), strict=True):
        fill[q].append((o, n))
    assert sorted(fill) == list(range(plan.sequences))
    padded = 0
    for pieces in fill.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces[:-1])]).tolist()
        total = sum(n for _, n in pieces)
        assert total <= 32
        padded += total != 32 and not (bare and power(total))
    assert padded <= (0 if bare else 1)


def test_least_squares():
    """Counts that shapes explain exactly are explained; the fit uses no negative count."""
    found = P.shapes(24)
    assert (found.sum(1) == 24).all() and len(found) == 12 + len({(a, b, 24 - a - b) for a in range(1, 9) for b in range(a, 24) if 24 - a - b >= b})
    x = np.zeros(len(found))
    x[[3, 17, 40]] = 5000, 900, 70
    histogram = sum(np.bincount(c, x, 24) for c in found.T)
    histogram[0] = 0
    got = P.repeat_counts(histogram, found, 2000)
    again = sum(np.bincount(c, got, 24) for c in found.T)
    again[0] = 0
    assert (got >= 0).all() and np.abs(again - histogram).max() < 1
    assert not P.repeat_counts(np.zeros(24), found).any()


def test_whole_rests_fill_most_windows():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(rng.exponential(60, 20_000).astype(int) + 1, 255), minlength=256)
    plan = P.make_plan(histogram, 256)
    length = np.repeat(np.arange(256), histogram)
    number = np.concatenate([np.arange(n) for n in histogram])
    rest, *_ = plan.pieces(length, number)
    cut = (np.bincount(rest) > 1).sum()
    assert cut < 0.1 * plan.sequences  # next-fit would cut at almost every window


@pytest.mark.parametrize("window", [16, 2048])
def test_odd_rows(spark, window):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "no id"), (None, None), (4, "far " * 5000), (4, "far " * 5000), (5, "far " * 15),
            (6, "a"), (6, "b c"), (7, " \n\t")] + [(i, "hot " * 11) for i in range(10, 60)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2, 3.0) for i, t in rows], "doc_id long, text string, part int, ids string, rest int, number double")
    pieces, sequences = check(P.pack(docs.repartition(5), PATH, window=window, with_ids=True).collect(), rows, window)
    assert P.pack(docs.limit(0), PATH, window=window).count() == 0
    with pytest.raises(ValueError, match="end id"):
        P.pack(docs, PATH, end_id=1 << 16)


def test_string_ids(spark):
    rows = [("b", "x"), ("a", "y z")]
    check(P.pack(spark.createDataFrame(rows, "doc_id string, text string"), PATH, window=64, with_ids=True).collect(), rows, 64)


def test_query(spark):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = P.pack(spark.read.parquet(f"{SMALL}/documents.parquet"), PATH, with_ids=True).collect()
    check(rows, documents, 2048)
    got = QUERIES["op11_packing"][0](spark, SMALL)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {tuple(r) for r in got.collect()} == {tuple(r)[:7] for r in rows}
