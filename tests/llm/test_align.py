from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomstat.llm import align as A
from loomstat.llm.queries import QUERIES

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(PATH_A)
TOKENIZER.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
ALIGNER = A.Aligner(PATH_A, PATH_B)
LETTERS = st.text(alphabet="aB éé'sx\r 　  \t\n\n..,(!1<|endoftext|>▁_​\U0001f600\U0001f9ff\x00한ß×÷", max_size=40)


def decoded():
    """Bytes of A's tokens by the printable stand-ins of GPT-2's published rule, of B's pieces by their names."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    stands, k = {}, 0
    for b in range(256):
        if b in plain:
            stands[chr(b)] = b
        else:
            stands[chr(256 + k)] = b
            k += 1
    return stands


STANDS = decoded()


def brute_tokens(text):
    """[(id, end)] of both tokenizers, whole text at once; None without tokens."""
    if not text:
        return None
    spaced = (" " + text).encode()
    ids = TOKENIZER.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(STANDS[c] for c in TOKENIZER.id_to_token(i))) for i in ids]
    b = []
    for i in PIECES.encode(text):
        piece = PIECES.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if PIECES.is_byte(i) else piece.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in side) != spaced for side in (a, b)):
        return None
    return [list(zip((i for i, _ in side), np.cumsum([len(x) for _, x in side]).tolist(), strict=True)) for side in (a, b)]


def brute(texts):
    found = [brute_tokens(t) for t in texts]
    links = []
    for both in found:
        a, b = both or ([], [])
        ends = {e: i for i, e in b}
        links.append([(i, ends[e]) for i, e in a if e in ends])
    count = Counter(p for row in links for p in row)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for both, own in zip(found, links, strict=True):
        if both is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = both
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, e in side if low < e <= high) for side in (a, b)))
            low = high
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((len(a), len(b), len(cuts), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), digest))
    return out


def chunk(aligner, texts):
    data = "".join(f" {t}" for t in texts).encode()
    return aligner(np.frombuffer(data, np.uint8), np.cumsum([0, *(len(t.encode()) + 1 for t in texts)]))


@settings(max_examples=400, deadline=None)
@given(st.lists(LETTERS.filter(bool), min_size=1, max_size=4))
def test_units_as_whole_texts(texts):
    counts, digests, links, limits = chunk(ALIGNER, texts)
    for i, (text, want) in enumerate(zip(texts, brute(texts), strict=True)):
        assert (*counts[i].tolist(), digests[i]) == (*want[:3], want[6]), text
        assert limits[i + 1] - limits[i] == want[3]


def test_words_are_encoded_apart():
    assert ALIGNER.split
    text = " Some words, others.\nNext line (it's 1990)\n\n twice  spaced"
    data = np.frombuffer((" " + text).encode(), np.uint8)
    starts = ALIGNER.cuts(data, np.array([0, len(data)]))
    pieces = [data[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert "".join(pieces) == " " + text
    assert {" words", "\n", "Next", "\n\n twice", " others", ","} <= set(pieces)


def test_spans_are_refined_by_bytes():
    text = " a\U0001f9ffb 한́"
    for spans, vocabulary, whole in ((ALIGNER.spans_a, ALIGNER.bytes_a, 0), (ALIGNER.spans_b, ALIGNER.bytes_b, 1)):
        ids, limits, begin, end = spans([text])
        sizes = vocabulary.sizes[ids]
        assert (end - begin != sizes).any()  # the spans alone do not say where the bytes of a character are cut
        assert A.spans_to_ends(limits, begin, end, sizes).tolist() == np.cumsum(sizes).tolist()
        assert vocabulary.spell(ids).tobytes() == text.encode()


def test_other_files_take_whole_texts():
    other = A.Aligner(PATH_A, PATH_B)
    other.split = False
    texts = ["Some words, others.", " lead", "\U0001f9ff", "a▁b", "trail  "]
    counts, digests, *_ = chunk(other, texts)
    assert [(*c, d) for c, d in zip(counts.tolist(), digests, strict=True)] == [(*w[:3], w[6]) for w in brute(texts)]


def test_forgotten_units(monkeypatch):
    monkeypatch.setattr(A, "MEMO", 20)
    aligner = A.Aligner(PATH_A, PATH_B)
    texts = [" ".join(f"word{i * j % 41}, the x{i}" for j in range(30)) for i in range(12)]
    for text, want in zip(texts, brute(texts), strict=True):
        counts, digests, links, limits = chunk(aligner, [text])
        assert (*counts[0].tolist(), digests[0]) == (*want[:3], want[6]) and len(aligner.memo.known) <= 20
        assert len(aligner.counts) == len(aligner.digests) == len(aligner.link_limits) - 1 == len(aligner.memo.known)


@pytest.mark.parametrize("most", [0, A.PAIRS])
def test_odd_rows(spark, most):
    texts = ["a word", "a word", None, "", "a▁b", "naïve \U0001f9ff <|endoftext|> <s>", "x " * 20_000, " ", "\n", "the the the. The"]
    ids = [1, 1, 2, 3, 4, None, None, 5, 6, 7]
    docs = spark.createDataFrame(list(zip(ids, texts, ids, texts, strict=True)), "doc_id long, text string, row long, links string").repartition(3)
    got = A.align(docs, PATH_A, PATH_B, most=most).collect()
    want = [(i, *w) for i, w in zip(ids, brute(texts), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    empty = A.align(docs.limit(0), PATH_A, PATH_B, most=most)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_align"][0](spark, SMALL).collect()}
    assert got == dict(zip((r.doc_id for r in rows), brute([r.text for r in rows]), strict=True))
