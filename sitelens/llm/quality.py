"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted over one feature at a time, cyclically, and each adds to
that feature's lookup table; then the pairs of features that best explain what is left
get tables of their own the same way. A score is the logistic of the sum of the looked
up bins, so every part of it can be read off a table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, held_out, table

#: The bound of the training sample, in rows, by hash order.
MAX_TRAIN_ROWS = 20_000
TRAIN_PARTS = 12
BINS, PAIR_BINS, PAIRS = 48, 12, 8
CYCLES, PAIR_CYCLES, RATE, LEAVES = 120, 40, 0.15, 3
SHRINK = 5.0
THRESHOLD = 0.3

FEATURES = (
    "words", "word_length", "long_words", "distinct", "top_share", "repeats", "runs", "lines", "distinct_lines",
    "line_length", "upper", "digits", "symbols", "symbol_kinds", "stops", "commas", "non_ascii", "junk_ends", "compress",
)

_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()!?-]")
_JUNK_END = re.compile(r"[^\w\s.,;:'\")?]\Z|!!\Z")


def text_features(text: str | None) -> list[float]:
    """FEATURES of a whole text; a text without words has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode("utf-8", "surrogatepass")
    symbols = _SYMBOLS.findall(text)
    after = sum(map(str.__eq__, words, words[1:]))
    far = sum(1 for a, b in zip(words, words[1:]) if counts[a] > 1 and counts[b] > 1)
    squeezed = sum(len(zlib.compress(data[k : k + 32768], 1)) for k in range(0, len(data), 32768))
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        sum(len(w) > 14 for w in words) / n,
        len(counts) / n**0.8,
        max(counts.values()) / n,
        far / n,
        after / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        sum(map(str.isupper, words)) / n,
        sum(map(str.isdigit, text)) / size,
        len(symbols) / n,
        float(len(set(symbols))),
        (text.count(".") + text.count("?")) / n,
        text.count(",") / n,
        (len(data) - size) / size,
        sum(1 for w in words if _JUNK_END.search(w)) / n,
        squeezed / len(data),
    ]


def _tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Per-bin output of a tree with LEAVES leaves over an ordered axis."""
    parts, out = [(0, len(grad))], np.zeros(len(grad))

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + SHRINK)

    for _ in range(LEAVES - 1):
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
            if b - a > 1:
                gain = worth(g[:-1], h[:-1]) + worth(g[-1] - g[:-1], h[-1] - h[:-1]) - worth(g[-1:], h[-1:])
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), k, a + at + 1))
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = -grad[a:b].sum() / (hess[a:b].sum() + SHRINK)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a pair table: its gain and per-cell output."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)

    def corners(c: np.ndarray) -> np.ndarray:
        a, top, left, all_ = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return np.stack([a, top - a, left - a, all_ - top - left + a])

    gs, hs = corners(g), corners(h)
    gain = (gs * gs / (hs + SHRINK)).sum(0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = -gs[:, i, j] / (hs[:, i, j] + SHRINK)
    cells = np.empty_like(grad)
    cells[: i + 1, : j + 1], cells[: i + 1, j + 1 :], cells[i + 1 :, : j + 1], cells[i + 1 :, j + 1 :] = out
    return float(gain[i, j]), cells


@dataclass
class Model:
    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, k], side="right")]
        for (a, b), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables. With rows of one label only, or none, every score is the base rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return model
    width = x.shape[1]
    model.cuts = [_cuts(x[:, k], BINS) for k in range(width)]
    model.coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(width)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(CYCLES):
        for k, values in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[k], g, len(values)), np.bincount(at[k], h, len(values)))
            values += step
            z += step[at[k]]
    low = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.coarse)]
    width_of = [len(c) + 1 for c in model.coarse]
    flat = lambda a, b: low[a] * width_of[b] + low[b]

    def cells(a: int, b: int) -> tuple[float, np.ndarray]:
        g, h = slopes()
        shape = (width_of[a], width_of[b])
        return _quadrants(*(np.bincount(flat(a, b), v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))

    able = [k for k in range(width) if width_of[k] > 1]
    gains = sorted(((cells(a, b)[0], a, b) for a, b in combinations(able, 2)), reverse=True)
    model.pairs = {(a, b): np.zeros((width_of[a], width_of[b])) for _, a, b in gains[:PAIRS]}
    for _ in range(PAIR_CYCLES):
        for (a, b), values in model.pairs.items():
            step = RATE * cells(a, b)[1]
            values += step
            z += step.ravel()[flat(a, b)]
    return model


def _matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"quality": rows["quality"], "x": [np.array(text_features(t)) for t in rows["text"]]})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows that have an id and aren't held out.

    Of repeated ids one takes part: the label is the highest, the text the least.
    """
    marks = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("int").alias("quality"))
    marks = marks.filter(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = F.broadcast(hash_sample(marks.withColumn("_all", F.lit(0)), "_all", "_id", MAX_TRAIN_ROWS).drop("_all"))
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    found = found.groupBy("_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    found = found.repartition(TRAIN_PARTS)
    rows = found.select("quality", "text").mapInPandas(_matrix, "quality int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    return fit(x, rows["quality"].to_numpy(dtype=np.float64))


def with_quality(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of whole texts, in place of a column of that name.

    Null and empty texts have zero features; equal texts have equal scores; all rows and
    other columns stay, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few small tables

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([text_features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(shared.value.score(x), dtype="float64")

    return docs.withColumn(into, score(F.col(text)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see with_quality."""
    docs = table(spark, sf_dir, "documents")
    scored = with_quality(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
