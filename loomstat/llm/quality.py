"""Quality classifier: learned vectors of hashed words, word pairs and character n-grams.

A document is the mean of the vectors of all its features; a softmax over a linear layer gives
its class.  Vectors and layer are trained by stochastic gradient descent in numpy.  For two
classes the layer can be applied to every vector beforehand, so that scoring adds one number
per feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import free_names, remainder, seeded_sample, stored

BUCKETS = 1 << 18
WIDTH = 16
GRAMS = (3, 4, 5)
#: A word that repeats the one before it, whichever it is.
AGAIN = np.uint64(0x5A17C0DE5A17C0DE)

# One value for all white space, so that a word's edges look alike on every line.
_EDGED = T._FOLDED.copy()
_EDGED[T._SPACE] = _EDGED[32]


def _slots(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (T.mix(hashes + np.uint64(kind * 0x632BE59BD9B4E019 & T.MASK)) & np.uint64(BUCKETS - 1)).astype(np.int32)


def feature_parts(words: T.Words, offsets: np.ndarray):
    """Yields (feature slots, document of each): words, word pairs, character n-grams with word edges."""
    docs = np.arange(len(offsets) - 1)
    doc_of_word = np.repeat(docs, words.counts)
    yield _slots(words.hash, 1), doc_of_word
    if len(words.hash) > 1:
        inside = doc_of_word[1:] == doc_of_word[:-1]
        left, right = words.hash[:-1][inside], words.hash[1:][inside]
        pair = np.where(left == right, AGAIN, left * np.uint64(0x9FB21C651E98DF25) + right)
        yield _slots(pair, 2), doc_of_word[1:][inside]
    total = T._running(_EDGED[words.data], "byte")
    back = T._power("byte", len(words.data) + 1)[1]
    blank = np.zeros(len(words.data) + 1, dtype=np.int32)
    np.cumsum(T._SPACE[words.data], out=blank[1:])
    end = np.repeat(offsets[1:], np.diff(offsets))  # of the document, for every byte
    for n in GRAMS:
        at = np.arange(max(len(words.data) - n + 1, 0))
        at = at[(at + n <= end[: len(at)]) & (blank[at + n - 1] == blank[at + 1])]
        yield _slots((total[at + n] - total[at]) * back[at], n), np.searchsorted(offsets, at, side="right") - 1


def _chunks(column: pa.Array):
    """(first row, row after the last, words, byte limits of the documents)."""
    _, offsets = T.raw_text(column)
    for row, end, words in T.chunks(column, fold=True):
        yield row, end, words, offsets[row : end + 1] - offsets[row]


@dataclass
class Model:
    """``vectors``: one row per slot; ``layer``: class by width; ``bias``: by class."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def odds(self) -> np.ndarray:
        """What a feature adds to the difference of the two outputs."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float64)


def _sparse(batches):
    """Each document as distinct slots and their shares."""
    for batch in batches:
        slots, shares = [], []
        for row, end, words, offsets in _chunks(batch["text"]):
            parts = list(feature_parts(words, offsets))
            slot = np.concatenate([p[0] for p in parts])
            doc = np.concatenate([p[1] for p in parts])
            key, count = np.unique(doc * BUCKETS + slot, return_counts=True)
            limits = np.searchsorted(key, np.arange(end - row + 1) * BUCKETS)
            for a, b in zip(limits[:-1], limits[1:], strict=True):
                slots.append((key[a:b] % BUCKETS).astype(np.int32).tobytes())
                shares.append((count[a:b] / max(count[a:b].sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["order"], batch["label"], pa.array(slots, pa.binary()), pa.array(shares, pa.binary())],
            ["order", "label", "slots", "shares"])


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int) -> Model:
    """Stochastic gradient descent over documents in seeded order, the step falling linearly to 0."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32)
    if examples:
        share = np.mean([y for y, *_ in examples])
        bias[1] = np.log((share + 1e-3) / (1 - share + 1e-3))
    done, all_steps = 0, epochs * max(len(examples), 1)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, slots, shares = examples[i]
            step = rate * (1 - done / all_steps)
            done += 1
            if not len(slots):
                continue
            own = vectors[slots]
            mean = shares @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0
            # A share is small; the step of the vectors is scaled so that one example can move its own mean.
            vectors[slots] = own - step * (shares / max(float(shares @ shares), 1e-3) ** 0.5)[:, None] * (p @ layer)
            layer -= 0.1 * step * np.outer(p, mean)
            bias -= 0.02 * step * p
    return Model(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        admit=None, sample_rows: int = 4_000, epochs: int = 8, rate: float = 1.0, seed: int = 5) -> Model:
    """A model from at most ``sample_rows`` labelled rows that ``admit`` (a column) lets pass.

    The sample takes the rows with the smallest hashes of their ids; it is trained in one task,
    whose size the bound limits.  Null ids and labels are ignored; of repeated ids the larger
    label counts.  Without labels every document gets an even score.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("_id is not null and label in (0, 1)")
    if admit is not None:
        known = known.where(admit("_id"))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    known = seeded_sample(known, "_id", sample_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    sample = sample.select(F.xxhash64("_id", "text").alias("order"), "label", F.coalesce("text", F.lit("")).alias("text"))
    sample = stored(sample.mapInArrow(_sparse, "order long, label int, slots binary, shares binary"), "quality-sample")

    def learn(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: r["order"])
        model = train([(r["label"], np.frombuffer(r["slots"], np.int32), np.frombuffer(r["shares"], np.float32))
                       for r in rows], epochs, rate, seed)
        yield pa.RecordBatch.from_pydict({k: [getattr(model, k).astype(np.float32).tobytes()]
                                          for k in ("vectors", "layer", "bias")})

    got = sample.coalesce(1).mapInArrow(learn, "vectors binary, layer binary, bias binary").collect()
    if not got:
        return train([], 0, rate, seed)
    shape = {"vectors": (BUCKETS, WIDTH), "layer": (2, WIDTH), "bias": (2,)}
    return Model(**{k: np.frombuffer(bytes(got[0][k]), np.float32).reshape(s) for k, s in shape.items()})


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3, score_col: str = "score",
          predicted_col: str = "predicted", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with the probability of class 1 and the decision.

    Whole texts are read.  Null and empty texts have no features and get the softmax of the
    bias.  Columns in ``keep`` (all if None) stay.
    """
    keep = docs.columns if keep is None else keep
    if clash := {score_col, predicted_col} & set(keep):
        raise ValueError(f"columns {sorted(clash)} exist already; name others")
    (hidden,) = free_names(docs, "_scored_text")
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(hidden))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema),
                        f"{score_col} double, {predicted_col} int"])
    odds = docs.sparkSession.sparkContext.broadcast(model.odds())  # 2 MB, whatever the data
    lean = float(model.bias[1] - model.bias[0])

    def scored(batches):
        table = odds.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for row, end, words, offsets in _chunks(batch[hidden]):
                total, n = np.zeros(end - row), np.zeros(end - row)
                for slots, doc in feature_parts(words, offsets):
                    total += np.bincount(doc, weights=table[slots], minlength=end - row)
                    n += np.bincount(doc, minlength=end - row)
                z[row:end] = total / np.maximum(n, 1)
            s = 1.0 / (1.0 + np.exp(-np.clip(z + lean, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                [*keep, score_col, predicted_col])

    return rows.mapInArrow(scored, schema)


def query(spark, folder: str) -> DataFrame:
    """``op5``: learns from rows whose remainder is not 0, scores every document."""
    from .shared import table

    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"), admit=lambda c: remainder(c, 5) != 0)
    return score(docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "text"), model,
                 keep=["doc_id", "held_out"])
