"""Text quality by a generalised additive model with pairwise interactions.

Each text becomes a fixed row of language-independent measures. Measures are cut into at most `BINS` bins; shallow trees,
boosted one feature after the other in turn, add up to one lookup table per feature, and trees over two features, for the
pairs that explain most of what is left, to one table per pair. A score is the logistic of a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnlens.llm.common import bounded_batches, cut, held_out, slices, texts

#: Labelled rows that a model is fitted on, at most: the first in the order of a hash of their id.
SAMPLE = 20_000
BINS = 48
#: `word_length` counts a word's length up to 64 (base64, URLs and the like would drown the others), `top_word` is 0 up to 20 words, where every word is frequent.
FEATURES = (
    "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "bare_words", "short_words", "long_words", "letters",
    "capitals", "marks", "digits", "spaces", "log_line_words", "repeated_lines", "entropy",
)

_CLASS = np.zeros(256, dtype=np.int64)  # 0 mark, 1 lower-case or other letter, 2 capital, 3 digit, 4 white space, 5 continuation
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 5 if 128 <= _b < 192 else 1 if _b >= 192 or "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t\n\r\v\f" else 0


def measures(text: str) -> list[float]:
    """The features of one text, all of them finite; zeros for a text without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    counts = Counter(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    mark, small, capital, digit, space, _ = np.bincount(_CLASS, weights=raw, minlength=6).tolist()
    chars = mark + small + capital + digit + space
    sizes = np.bincount(np.minimum(np.fromiter(map(len, words), dtype=np.int64, count=n), 64), minlength=65)
    lines = [x for x in text.split("\n") if x.strip()]
    share = raw[raw > 0] / raw.sum()
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    return [
        float(np.log1p(n)),
        float(sizes @ np.arange(65)) / n,
        float(np.log1p(len(counts)) / np.log1p(n)),
        max(counts.values()) / n if n > 20 else 0.0,
        sum(map(eq, words, words[1:])) / n,
        bare / n,
        float(sizes[:4].sum()) / n,
        float(sizes[13:].sum()) / n,
        (small + capital) / chars,
        capital / max(small + capital, 1.0),
        mark / chars,
        digit / chars,
        space / chars,
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()),
    ]


def features(docs: DataFrame) -> DataFrame:
    """`doc_id, x` (an array of floats) for every row, from the whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [measures(t) for t in texts(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, type=pa.list_(pa.float64()))], names=["doc_id", "x"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    """Cut points per feature, a table per feature and per pair, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of feature rows: one table lookup and addition per feature and pair."""
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[at[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between quantiles, halfway to the next value."""
    seen = np.unique(values)
    if len(seen) > bins:
        seen = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="nearest"))
    return (seen[1:] + seen[:-1]) / 2


def _tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A shallow tree over the bins of one feature: the best splits one after the other, then a Newton step per leaf."""
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(hessian))
    ends = [0, len(gradient)]
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    for _ in range(leaves - 1):
        best, where = 1e-9, -1
        for a, b in zip(ends, ends[1:]):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                if gain.max() > best:
                    best, where = gain.max(), int(m[gain.argmax()])
        if where < 0:
            break
        ends = sorted([*ends, where])
    return np.repeat([-(g[b] - g[a]) / (h[b] - h[a] + ridge) for a, b in zip(ends, ends[1:])], np.diff(ends))


def _quarters(gradient: np.ndarray, hessian: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain and its table."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    parts = lambda t: (t[:-1, :-1], t[:-1, -1:] - t[:-1, :-1], t[-1:, :-1] - t[:-1, :-1], t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + t[:-1, :-1])
    gs, hs = parts(g), parts(h)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs)) - g[-1, -1] ** 2 / (h[-1, -1] + ridge)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = [-a[i, j] / (b[i, j] + ridge) for a, b in zip(gs, hs)]
    low, left = np.arange(g.shape[0])[:, None] <= i, np.arange(g.shape[1])[None, :] <= j
    return float(gain[i, j]), np.where(low, np.where(left, leaf[0], leaf[1]), np.where(left, leaf[2], leaf[3]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.1, leaves: int = 3, ridge: float = 1.0) -> Model:
    """Cyclic boosting on feature rows and 0/1 labels. No rows: a model that scores everything 0.5."""
    width = len(FEATURES)
    if not len(y):
        return Model([np.zeros(0)] * width, [np.zeros(1)] * width, [], [], 0.0)
    edges = [_cuts(x[:, j], BINS) for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(edges, tables, [], [], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    at = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes(cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cell, weights=p - y, minlength=cells), np.bincount(cell, weights=p * (1 - p), minlength=cells)

    for _ in range(rounds):
        for j in range(width):
            step = rate * _tree(*slopes(at[:, j], len(tables[j])), leaves, ridge)
            tables[j] += step
            total += step[at[:, j]]
    shapes = {(i, j): (len(tables[i]), len(tables[j])) for i, j in combinations(range(width), 2)}
    cells = lambda i, j: at[:, i] * shapes[i, j][1] + at[:, j]
    gains = {(i, j): _quarters(*(s.reshape(shape) for s in slopes(cells(i, j), shape[0] * shape[1])), ridge)[0] for (i, j), shape in shapes.items()}
    for pair in sorted(gains, key=lambda k: (-gains[k], k))[:pairs]:
        model.pairs.append(pair)
        model.pair_tables.append(np.zeros(shapes[pair]))
    for _ in range(pair_rounds):
        for pair, table in zip(model.pairs, model.pair_tables):
            cell = cells(*pair)
            _, tree = _quarters(*(s.reshape(table.shape) for s in slopes(cell, table.size)), ridge)
            table += rate * tree
            total += rate * tree.ravel()[cell]
    return model


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`doc_id, y` of the labelled rows to learn from: 0/1 qualities, none held out; a document with several takes the lowest."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y"))
    return usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def learn(measured: DataFrame, chosen: DataFrame) -> Model:
    """Fit on the measured rows (doc_id, x) of the chosen documents (doc_id, y), which are so few that they can be sent to every task."""
    rows = measured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "x").agg(F.min("y").alias("y")).orderBy("doc_id", "x").select("x", "y").collect()
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows], dtype=float))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text; all else is ignored).

    The texts are read once; their measures are kept for training and scoring. Null texts are empty, rows without an id are
    scored and never trained on, and an empty table of documents gives an empty result; without labels every score is 0.5.
    """
    measured = cut(features(docs))
    model = learn(measured, training_labels(labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, all their columns, that score 0.5 or more. The model is learned from the given documents and labels.

    Only the labelled documents are measured for training; the others are measured as they are scored.
    """
    chosen = cut(training_labels(labels, sample))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    model = learn(features(some), chosen)

    @F.pandas_udf("boolean")
    def good(text):
        found = [measures(t) if isinstance(t, str) else measures("") for t in text]
        return text.__class__(model.scores(np.array(found, dtype=float).reshape(len(found), len(FEATURES))) >= 0.5, dtype=bool, index=text.index)

    return bounded_batches(docs).where(good(F.col("text").cast("string")))
