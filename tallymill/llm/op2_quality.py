"""Quality classifier: a generalised additive model with pairwise interactions.

Shape functions are lookup tables over quantile bins of text features. They
are learned by cyclic boosting: round by round each feature in turn gets a
small step along a shallow tree over its bins, fitted to the logistic gradient
of the rows; then the pairs of features that explain most of what remains get
two-dimensional tables by the same cycle. A document's score is the logistic
of the intercept plus one table entry per feature and pair.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2,
of which those with the ``SAMPLE`` smallest hashes at most are gathered on the
driver (a row is some 200 bytes). Texts alone give features.

Edge cases: null and empty texts have the features of an empty text; documents
without a usable label, or labels of one kind only, give a constant score (the
share of good labels, or 0.5); a doc_id with labels of both kinds counts as
both; repeated rows are scored one by one; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm.batches import bounded_batches
from tallymill.llm.rows import free_name
from tallymill.session import materialize

SAMPLE = 20_000
THRESHOLD = 0.7
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 120, 0.15, 8, 8, 40
FEATURES = [
    "log_words", "mean_word", "short_words", "distinct", "top_word", "repeats", "upper", "digits", "blanks", "high", "stops",
    "marks", "odd_marks", "pipes", "bangs", "lines", "line_words", "repeated_lines", "capital_words", "pair_repeats",
]
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in "#$%&*@^_+=<>~{}[]\\/`|"]] = True
_MARKS = np.zeros(256, bool)
_MARKS[33:48] = _MARKS[58:65] = _MARKS[91:97] = _MARKS[123:127] = True


def features(text: str | None) -> np.ndarray:
    """The features of one whole text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    bag = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    of = lambda mask: counts[mask].sum() / size
    return np.array([
        np.log1p(n), lengths.mean(), np.mean(lengths <= 3), len(bag) / n, max(bag.values()) / n, same / n, of(_UPPER), counts[48:58].sum() / size, counts[[32, 9]].sum() / size, counts[128:].sum() / size, counts[46] / n,
        of(_MARKS), of(_ODD), counts[124] / n, counts[33] / n, np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(w[:2].isupper() and len(w) > 1 for w in words) / n, 1 - pairs / max(1, n - 1),
    ])


def _tree_step(gain_g: np.ndarray, gain_h: np.ndarray, splits: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Newton values per bin of a tree of up to ``splits`` cuts over ordered bins, grown best first."""
    g, h = np.concatenate(([0], np.cumsum(gain_g))), np.concatenate(([0], np.cumsum(gain_h)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    def best(a, b):
        cuts = np.arange(a + 1, b)
        if not len(cuts):
            return (0.0, 0, a, b)
        gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
        i = int(np.argmax(gains))
        return (float(gains[i]), int(cuts[i]), a, b)

    leaves = [best(0, len(gain_g))]
    for _ in range(splits):
        top = max(leaves)
        if top[0] <= 1e-9:
            break
        leaves.remove(top)
        leaves += [best(top[2], top[1]), best(top[1], top[3])]
    out = np.zeros(len(gain_g))
    for _, _, a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _tree_step_2d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One cut along the first axis, then a tree of its own on either side."""
    rows = _tree_step(g.sum(1), h.sum(1), 1)
    cut = int(np.flatnonzero(np.diff(rows))[0]) + 1 if np.any(np.diff(rows)) else len(rows)
    out = np.empty_like(g)
    for part in (slice(0, cut), slice(cut, len(rows))):
        out[part] = _tree_step(g[part].sum(0), h[part].sum(0), 1)[None, :]
    return out


class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    def __init__(self):
        self.intercept, self.edges, self.tables = 0.0, [], []
        self.pair_edges, self.pairs, self.pair_tables = [], [], []
        self.constant: float | None = 0.5
        self.n_labels = 0

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        self.n_labels = len(y)
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.constant = None
        base = float(y.mean())
        self.intercept = float(np.log(base / (1 - base)))
        self.edges = [self._edges(c, BINS) for c in x.T]
        self.pair_edges = [self._edges(c, PAIR_BINS) for c in x.T]
        codes = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        coarse = [np.searchsorted(e, c, side="right") for e, c in zip(self.pair_edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(len(y), self.intercept)
        for _ in range(ROUNDS):
            for f, code in enumerate(codes):
                p = 1 / (1 + np.exp(-total))
                n = len(self.tables[f])
                step = RATE * _tree_step(np.bincount(code, y - p, n), np.bincount(code, p * (1 - p), n))
                self.tables[f] += step
                total += step[code]
        p = 1 / (1 + np.exp(-total))
        strength = []
        for a in range(x.shape[1]):
            for b in range(a):
                shape = (len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1)
                flat = coarse[a] * shape[1] + coarse[b]
                g, h = np.bincount(flat, y - p, shape[0] * shape[1]), np.bincount(flat, p * (1 - p), shape[0] * shape[1])
                strength.append((float(np.sum(g * g / (h + 1.0))), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(strength, reverse=True)[:PAIRS]]
        flats = []
        for a, b in self.pairs:
            shape = (len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1)
            self.pair_tables.append(np.zeros(shape))
            flats.append(coarse[a] * shape[1] + coarse[b])
        for _ in range(PAIR_ROUNDS):
            for table, flat in zip(self.pair_tables, flats, strict=True):
                p = 1 / (1 + np.exp(-total))
                g, h = np.bincount(flat, y - p, table.size), np.bincount(flat, p * (1 - p), table.size)
                step = RATE * _tree_step_2d(g.reshape(table.shape), h.reshape(table.shape))
                table += step
                total += step.ravel()[flat]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(x):
            return np.full(len(x), self.constant if self.constant is not None else 0.5)
        total = np.full(len(x), self.intercept)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            total += t[np.searchsorted(e, c, side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))

    def to_json(self) -> str:
        return json.dumps({k: [v.tolist() if isinstance(v, np.ndarray) else v for v in x] if isinstance(x, list) else x for k, x in vars(self).items()})


def held_out(key: Column) -> Column:
    """Whether a row may not be learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> AdditiveModel:
    """Fit on at most ``sample`` labelled rows, those with the smallest hashes of the key."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.select(F.col(key).alias("__key"), F.col("quality").cast("int").alias("__y")).distinct()
    chosen = known.orderBy(F.xxhash64("__key"), "__key", "__y").limit(sample)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(t).tolist() for t in batch["text"]]
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "x": x})

    # a repeated doc_id must not multiply the sample: one text a label, the least by its hash
    texts = docs.select(F.col(key).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("__id") == F.col("__key"))
    some = joined.select(F.col("__key").alias("k"), F.col("__y").alias("y"), "text")
    with bounded_batches(docs.sparkSession):
        taken = some.mapInPandas(rows, "k long, y int, x array<double>").groupBy("k", "y").agg(F.min("x").alias("x")).toPandas()
    taken = taken.sort_values(["k", "y"])
    x = np.array(taken["x"].tolist(), float).reshape(-1, len(FEATURES))
    return AdditiveModel().fit(x, taken["y"].to_numpy(float))


def scorer(model: AdditiveModel):
    """The model travels with the function: its tables are some ten kilobytes."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    score = scorer(train(docs, labels, key=key, text=text))
    scored = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), score(F.col(text)).alias("score"))
    with bounded_batches(docs.sparkSession):
        return materialize(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "scored")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good; all of them where there is nothing to learn from.

    The plan is run by the caller, who bounds the Arrow batches (see batches.py).
    """
    model = train(docs, labels)
    if not model.n_labels:
        return docs
    score = scorer(model)
    name = free_name(docs.columns, "__quality")
    return docs.withColumn(name, score(F.col("text"))).filter(F.col(name) >= threshold).select(*docs.columns)
