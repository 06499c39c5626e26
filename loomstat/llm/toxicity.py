"""Toxicity by a weighted finite-state pattern grammar.

Tokens become symbols (insult, threat, target, negation, reported speech, other, clause end).
Four rewriting transducers and one that names what it reads are composed into one
deterministic machine; run over a document it counts the matched clause patterns, and a
document's score is the logistic of their weights.  The insult terminals are a seed list plus
words and word beginnings learned from labels; pattern weights are fitted to the same labels,
around fixed starting weights.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .shared import drop_worker_cache, free_names, release_memory, remainder, seeded_sample, stored

STRIPPED = ".,;:!?\"'()[]{}<>*%&$#|~_=+/\\-«»“”„‘’…¡¿"
CLAUSE_END = tuple(".,;:!?…")

# Seed terminals.
SEEDS = {
    "insult": "idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown imbecile"
              " dumbass bastard retard scumbag dimwit halfwit vermin filthy idiota imbécil estúpido basura escoria"
              " payaso trottel dummkopf abschaum arschloch versager idiote imbécile connard ordure crétin",
    "threat": "kill murder destroy strangle punch stab matar golpear töten schlagen umbringen tuer frapper détruire",
    "target": "you your yours yourself he she they them him her people du dich dir ihr euch sie tu te toi vous tú te"
              " usted ustedes ellos",
    "negation": "not no never none nobody isn't aren't wasn't don't nicht kein keine nie ne pas jamais sin nunca",
    "report": "said says called claimed wrote quoted reported alleged sagte schrieb nannte dit écrit appelé dijo"
              " escribió llamó",
}

#: Symbols of the composed machine's input.
CLASSES = ("other", "insult", "threat", "target", "negation", "report", "end")
CODE = {name: i for i, name in enumerate(CLASSES)}
#: Bit of a token code that says that a clause ends after the token.
ENDS = 8

SCOPE = 3  # tokens that a negation reaches
PATTERNS = ("insult", "insult~", 'insult"', 'insult~"', "insult@", "threat@", "threat@~", 'threat@"')
START = dict(zip(PATTERNS, (7.0, 2.0, 3.0, 1.0, 1.0, 4.5, 1.0, 1.0), strict=True))
START_BIAS = -4.0


@dataclass
class Transducer:
    """Deterministic: ``step(state, symbol)`` gives the next state and the symbol written."""

    start: object
    step: object

    def __rshift__(self, after: Transducer) -> Transducer:
        """Composition: ``after`` reads what this one writes."""

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = after.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, after.start), step)


def kind(symbol: str) -> str:
    return symbol.rstrip('~"@')


def negation() -> Transducer:
    """Marks insults and threats up to ``SCOPE`` tokens after a negation of the same clause."""

    def step(left, symbol):
        if symbol == "end":
            return 0, symbol
        if symbol == "negation":
            return SCOPE, symbol
        marked = symbol + "~" if left and kind(symbol) in ("insult", "threat") else symbol
        return max(left - 1, 0), marked

    return Transducer(0, step)


def reported() -> Transducer:
    """Marks insults and threats that follow a verb of saying in the same clause."""

    def step(inside, symbol):
        if symbol == "end":
            return False, symbol
        if symbol == "report":
            return True, symbol
        return inside, symbol + '"' if inside and kind(symbol) in ("insult", "threat") else symbol

    return Transducer(False, step)


def targeted() -> Transducer:
    """Marks an insult or threat after a target, and a target after an insult or threat, in one clause."""

    def step(seen, symbol):
        if symbol == "end":
            return "", symbol
        k = kind(symbol)
        if k == "target":
            return seen or "target", f"{seen}@" if seen not in ("", "target") else symbol
        if k in ("insult", "threat"):
            return (symbol if seen in ("", "target") else seen), symbol + "@" if seen == "target" else symbol
        return seen, symbol

    return Transducer("", step)


def named() -> Transducer:
    """Writes the pattern that a marked symbol stands for, or nothing."""

    def step(state, symbol):
        k, marks = kind(symbol), set(symbol[len(kind(symbol)):])
        if k == "insult":
            base = "insult" + "~" * ("~" in marks) + '"' * ('"' in marks)
            return state, (base, "insult@") if "@" in marks and base == "insult" else (base,)
        if k == "threat" and "@" in marks:
            return state, ("threat@" + ("~" if "~" in marks else '"' if '"' in marks else ""),)
        return state, ()

    return Transducer(None, step)


def machine() -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """The composed grammar as tables: next state and patterns written, by state and class code."""
    whole = negation() >> reported() >> targeted() >> named()
    number, todo, go, out = {whole.start: 0}, [whole.start], [], []
    while len(go) < len(todo):
        row, wrote = [], []
        for symbol in CLASSES:
            state, patterns = whole.step(todo[len(go)], symbol)
            if state not in number:
                number[state] = len(number)
                todo.append(state)
            row.append(number[state])
            wrote.append(tuple(PATTERNS.index(p) for p in patterns))
        go.append(row)
        out.append(wrote)
    return go, out


@dataclass
class Lexicon:
    """Terminals: whole words by class, and word beginnings that are insults."""

    words: dict[str, str] = field(default_factory=lambda: {w: c for c, s in reversed(SEEDS.items()) for w in s.split()})
    beginnings: frozenset[str] = frozenset()

    def code(self, token: str) -> int:
        word = token.lower().strip(STRIPPED)
        name = self.words.get(word)
        if name is None and any(word[:n] in self.beginnings for n in range(3, min(7, len(word)))):
            name = "insult"
        return CODE[name or "other"] + ENDS * token.endswith(CLAUSE_END)


class Codes(dict):
    """Token → code, looked up once for each of the last ``LIMIT`` different tokens."""

    LIMIT = 400_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        code = self[token] = self.lexicon.code(token)
        return code


class Matcher:
    """Counts of matched patterns of a text."""

    HOT = bytes(c + e for c in (CODE["insult"], CODE["threat"]) for e in (0, ENDS))

    def __init__(self, lexicon: Lexicon):
        self.codes = Codes(lexicon)
        self.go, self.out = machine()

    def __call__(self, body: str | None) -> list[int]:
        found = [0] * len(PATTERNS)
        line = bytes(map(self.codes.__getitem__, (body or "").split()))
        if len(line.translate(None, self.HOT)) == len(line):
            return found  # neither an insult nor a threat: no pattern writes anything
        state, go, out, end = 0, self.go, self.out, CODE["end"]
        for code in line:
            symbol = code & 7
            for p in out[state][symbol]:
                found[p] += 1
            state = go[state][symbol]
            if code & ENDS:
                state = go[state][end]
        return found


@dataclass
class Model:
    lexicon: Lexicon
    bias: float
    weights: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        z = self.bias + np.log2(1.0 + counts) @ self.weights
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def features(body: str | None) -> set[str]:
    """Whole words, and beginnings of 3 to 6 characters (with a star) of longer words."""
    words = {w for t in (body or "").split() if (w := t.lower().strip(STRIPPED))}
    return words | {w[:n] + "*" for w in words for n in range(3, min(7, len(w)))}


def _support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, copy key, label) is counted once for each copy key of a partition's rows."""
    seen: dict[int, set] = {0: set(), 1: set()}
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for copy, label, body in zip(batch["copy"].to_pylist(), batch["label"].to_pylist(), batch["text"].to_pylist(),
                                     strict=True):
            if copy in seen[label]:
                continue
            seen[label].add(copy)
            for f in features(body):
                counts[f][label] += 1
    if counts:
        yield pa.RecordBatch.from_pydict({"feature": list(counts), "n0": [c[0] for c in counts.values()],
                                          "n1": [c[1] for c in counts.values()]},
                                         pa.schema([("feature", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())]))


def _with_copy_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of four words: near copies mostly agree on it."""
    for batch in batches:
        keys = np.zeros(batch.num_rows, dtype=np.int64)
        for row, end, words in T.chunks(batch["text"], fold=True):
            h, first = words.runs(4)
            short = np.diff(first) == 0
            low = np.minimum.reduceat(np.append(h, np.uint64(0)), np.minimum(first[:-1], len(h))).view(np.int64)
            keys[row:end] = np.where(short, np.diff(words.first) + words.data.size % 977, low)
        yield pa.RecordBatch.from_arrays([batch["label"], batch["text"], pa.array(keys)], ["label", "text", "copy"])


def g_squared(n1: float, n0: float, all1: int, all0: int) -> float:
    """Log-likelihood ratio of a feature against the base rate of label 1, 0 if it is rarer there."""
    rate, n = all1 / (all1 + all0), n1 + n0
    if n == 0 or n1 / n <= rate:
        return 0.0
    part = lambda x, p: x * math.log(x / (n * p)) if x else 0.0
    return 2 * (part(n1, rate) + part(n0, 1 - rate))


def _learn_terminals(sample: DataFrame, least: float, precision: float, candidates: int) -> Lexicon:
    """Greedy cover: the strongest feature first, then the strongest on positives it leaves unexplained."""
    lexicon = Lexicon()
    totals = dict(sample.select("label", "copy").distinct().groupBy("label").count().collect())
    all1, all0 = totals.get(1, 0), totals.get(0, 0)
    if not all1 or not all0:
        return lexicon
    support = sample.mapInArrow(_support, "feature string, n0 long, n1 long").groupBy("feature").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    good = (support.where((F.col("n1") >= 4) & (F.col("n0") <= (1 - precision) * F.col("n1")))
            .orderBy(F.desc("n1"), "feature").limit(candidates).collect())
    n0 = {r.feature: r.n0 for r in good}

    def present(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(
                {"copy": batch["copy"].to_pylist(),
                 "found": [[f for f in features(b) if f in n0] for b in batch["text"].to_pylist()]},
                pa.schema([("copy", pa.int64()), ("found", pa.list_(pa.string()))]))

    by_copy: dict[int, set[str]] = defaultdict(set)
    for copy, found in sample.where("label = 1").mapInArrow(present, "copy long, found array<string>").collect():
        by_copy[copy].update(found)
    left = Counter(f for found in by_copy.values() for f in found)
    words, beginnings = dict(lexicon.words), set()
    for word in [w for w, c in words.items() if c == "insult"]:  # seeds first: what they explain needs no new terminal
        explained = [k for k, found in by_copy.items() if word in found]
        for k in explained:
            left.subtract(by_copy.pop(k))
    while left:
        best = max(left, key=lambda f: (g_squared(left[f], n0[f], all1, all0), f.endswith("*"), -len(f), f))
        if left[best] < 4 or g_squared(left[best], n0[best], all1, all0) < least:
            break
        if best.endswith("*"):
            beginnings.add(best[:-1])
        else:
            words[best] = "insult"
        for k in [k for k, found in by_copy.items() if best in found]:
            left.subtract(by_copy.pop(k))
    return Lexicon(words, frozenset(beginnings))


def _counts(matcher: Matcher, bodies: list) -> np.ndarray:
    return np.array([matcher(b) for b in bodies], dtype=np.float64).reshape(len(bodies), len(PATTERNS))


def _fit_weights(x: np.ndarray, y: np.ndarray, hold: float = 1.0, steps: int = 50) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps, held near the starting weights by a quadratic penalty."""
    centre = np.array([START_BIAS, *START.values()])
    x = np.hstack([np.ones((len(x), 1)), np.log2(1.0 + x)])
    w = centre.copy()
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + hold * (w - centre)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train=None, sample_rows: int = 20_000, least: float = 40.0, precision: float = 0.95,
        candidates: int = 20_000) -> Model:
    """Terminals and weights from at most ``sample_rows`` labelled rows that ``train`` (a column) admits.

    The sample takes the rows with the smallest hashes of their ids.  Null ids and labels are
    ignored; of repeated ids the larger label counts.  Without labels the seeds and starting
    weights stand.  Near copies count once.  ``least`` is the smallest likelihood ratio, and
    ``precision`` the smallest share of label 1, of a learned terminal.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("_id is not null and label in (0, 1)")
    if train is not None:
        known = known.where(train("_id"))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    known = seeded_sample(known, "_id", sample_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "_id")
    sample = stored(sample.select("label", F.coalesce("text", F.lit("")).alias("text"))
                    .mapInArrow(_with_copy_key, "label int, text string, copy long"), "toxic-sample")
    lexicon = _learn_terminals(sample, least, precision, candidates)

    def counted(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            found = Counter((label, *matcher(body)) for label, body in
                            zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True))
            yield pa.RecordBatch.from_pydict({"row": [list(k) for k in found], "n": list(found.values())},
                                             pa.schema([("row", pa.list_(pa.int64())), ("n", pa.int64())]))

    found = sample.mapInArrow(counted, "row array<long>, n long").groupBy("row").sum("n").collect()
    if not found:
        return Model(lexicon, START_BIAS, np.array([*START.values()]))
    rows = np.repeat(np.array([r[0] for r in found], dtype=np.float64), [r[1] for r in found], axis=0)
    return Model(lexicon, *_fit_weights(rows[:, 1:], rows[:, 0]))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7, score_col: str = "score",
          predicted_col: str = "predicted", keep: list[str] | None = None, patterns: bool = False) -> DataFrame:
    """The rows of ``docs`` with score and decision; columns in ``keep`` (all if None) stay.

    Null and empty texts match nothing and get the score of a text without patterns.  Whole
    texts are read.  ``patterns`` adds a map column of matched clause patterns.
    """
    keep = docs.columns if keep is None else keep
    clash = {score_col, predicted_col, *(["patterns"] if patterns else [])} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already; name others")
    # A text that stays is sent to the workers once.
    stays = text_col in keep and docs.schema[text_col].dataType.typeName() == "string"
    hidden = text_col if stays else free_names(docs, "_scored_text")[0]
    rows = docs.select(*keep) if stays else docs.select(*keep, F.col(text_col).cast("string").alias(hidden))
    extra = f"{score_col} double, {predicted_col} int" + ", patterns map<string,long>" * patterns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), extra])

    def scored(batches):
        drop_worker_cache()
        matcher = Matcher(model.lexicon)
        for batch in batches:
            counts = _counts(matcher, batch[hidden].to_pylist())
            s = model.scores(counts)
            columns = [batch[c] for c in keep]
            columns += [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            names = [*keep, score_col, predicted_col]
            if patterns:
                columns.append(pa.array([{p: int(n) for p, n in zip(PATTERNS, c, strict=True) if n} for c in counts],
                                        pa.map_(pa.string(), pa.int64())))
                names.append("patterns")
            yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    return rows.mapInArrow(scored, schema)


def query(spark, folder: str) -> DataFrame:
    """``op3``: learns from rows whose remainder is not 1, scores every document."""
    from .shared import table

    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"), train=lambda c: remainder(c, 3) != 1)
    held = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return score(held, model, keep=["doc_id", "held_out"])
