"""Counterfactually regularised toxicity classifier.

A logistic model over the rates of a text's words, each seen as itself and by its first
3, 4 and 5 letters, all hashed; features whose frequency differs clearly between the
labels take part, and those of every identity term that the labelled texts hold. Each
labelled text with an identity term is copied with the term swapped for its group's
neutral noun and, in turn, for other terms of the group; the squared change of the score
is part of the loss. It moves the term that the text has, not its stand-ins, so what a
term picked up from the labels goes, rather than spreading to the others. Terms that no
labelled text holds meet the same penalty in labelled texts that mention them at the end.

Since a text's score is a mean of its words' scores, scoring is one cached lookup per
word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, hash_sample, held_out, private, table

BUCKETS = 1 << 17
#: The bound of the training sample: so many labelled texts of each label, by hash order.
MAX_PER_LABEL = 6_000
#: Most features a model weighs: those whose frequency differs most clearly.
MOST_FEATURES = 4_000
SAMPLE_PARTS = 12
#: Weight of the squared score changes beside the loss; swaps of a text to terms other than the neutral
#: noun; labelled texts that mention each pair of a neutral noun and a term.
PENALTY, SWAPS_EACH, MENTIONS = 100.0, 4, 8
RIDGE = 1e-4
ROUNDS = 200
#: Least z value of a feature's difference in frequency.
CLEAR = 3.5
#: A text of n words has the feature values SCALE * count / (n + PRIOR_WORDS).
SCALE, PRIOR_WORDS = 50.0, 30
CACHE_ENTRIES = 200_000

#: Groups of identity terms that can stand for each other; the first is the neutral noun.
IDENTITY_GROUPS: dict[str, tuple[str, ...]] = {
    "gender": ("people", "women", "men", "girls", "boys", "transgender", "nonbinary", "females", "males"),
    "person": ("person", "woman", "man", "girl", "boy"),
    "religion": ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    "faith": ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    "origin": ("local", "african", "american", "arab", "asian", "chinese", "european", "french", "german", "indian", "irish", "italian", "japanese", "latino", "mexican", "polish", "russian", "spanish", "turkish"),
    "colour": ("human", "black", "white", "brown", "indigenous"),
    "orientation": ("adult", "gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    "condition": ("resident", "disabled", "deaf", "blind", "autistic", "elderly", "young"),
    "status": ("residents", "immigrants", "refugees", "migrants", "foreigners", "citizens"),
    "fr": ("personnes", "femmes", "hommes", "musulmans", "juifs", "chrétiens", "immigrés", "étrangers"),
    "de": ("menschen", "frauen", "männer", "muslime", "juden", "christen", "ausländer", "flüchtlinge"),
    "es": ("personas", "mujeres", "hombres", "musulmanes", "judíos", "cristianos", "inmigrantes", "extranjeros"),
}
TERMS = sorted({t for group in IDENTITY_GROUPS.values() for t in group})
GROUP_OF = {t: group for group in IDENTITY_GROUPS.values() for t in group}

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def features(word: str) -> list[int]:
    """The hashed features of a word."""
    parts = [f"={word}", *(f"^{word[:n]}" for n in (3, 4, 5) if len(word) >= n)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        cache: dict[str, float] = {}

        def word_score(word: str) -> float:
            if len(cache) >= CACHE_ENTRIES:
                cache.clear()
            x = cache[word] = float(self.weights[features(word)].sum())
            return x

        def score(text: str | None) -> float:
            words = words_of(text)
            total = sum(cache[w] if w in cache else word_score(w) for w in words)
            z = self.bias + SCALE * total / (len(words) + PRIOR_WORDS)
            return 1 / (1 + math.exp(-min(max(z, -30), 30)))

        return score


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text): the bounded sample of labelled texts to learn from.

    Rows without an id, text or label and those that are held out never take part. Of
    repeated ids one takes part: the label is the highest, the text the least.
    """
    marks = labels.filter("toxic in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = F.broadcast(hash_sample(marks, "toxic", "_id", MAX_PER_LABEL))  # twice MAX_PER_LABEL ids at most
    found = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))
    found = found.groupBy("_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return durable(found.select("toxic", "text").repartition(SAMPLE_PARTS))


def _features_of(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    words = words_of(text)
    return words, *np.unique(np.array([f for w in words for f in features(w)], dtype=np.int64), return_counts=True)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many texts of each label have each feature, for a partition."""
    hits = np.zeros((2, BUCKETS), dtype="<i4")
    rows = [0, 0]
    for part in batches:
        for label, text in zip(part["toxic"], part["text"]):
            hits[label, _features_of(text)[1]] += 1
            rows[label] += 1
    yield pd.DataFrame({"n0": [rows[0]], "n1": [rows[1]], "hits": [hits.tobytes()]})


@dataclass
class Copies:
    """Swapped copies of labelled texts: the score of text ``row``, with its words' share taken
    ``scale`` times and ``extra`` of the word ``a``, against the same with ``k`` of ``a`` become ``b``.
    ``moved`` is the term that the penalty moves."""

    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    k: np.ndarray
    scale: np.ndarray
    extra: np.ndarray
    weight: np.ndarray
    moved: np.ndarray


def swapped_copies(words: np.ndarray, terms: list[dict[str, int]], each: np.ndarray) -> Copies:
    """Of texts of so many words with so often these terms; ``each`` is a text's weight in the loss."""
    at = {t: k for k, t in enumerate(TERMS)}
    out = []
    for row, found in enumerate(terms):
        swaps = []
        for a, often in sorted(found.items()):
            noun, others = GROUP_OF[a][0], [t for t in GROUP_OF[a][1:] if t != a]
            turn = [others[(row * SWAPS_EACH + k) % len(others)] for k in range(min(SWAPS_EACH, len(others)))]
            swaps += [(a, b, SCALE * often / (words[row] + PRIOR_WORDS)) for b in [noun, *turn] if b != a]
        out += [(row, at[a], at[b], k, 1.0, 0.0, each[row] / len(swaps), at[a]) for a, b, k in swaps]
    pairs = [(group[0], t) for group in IDENTITY_GROUPS.values() for t in group[1:]]
    for n, (noun, term) in enumerate(pairs):
        for m in range(min(MENTIONS, len(words))):
            row = (n * MENTIONS + m) * 7919 % len(words)
            longer = words[row] + 1 + PRIOR_WORDS
            k = SCALE / longer
            out.append((row, at[noun], at[term], k, (longer - 1) / longer, k, 1 / (MENTIONS * len(pairs)), at[term]))
    columns = list(zip(*out)) or [()] * 8
    whole = {0, 1, 2, 7}
    return Copies(*[np.array(c, dtype=np.int64 if n in whole else np.float64) for n, c in enumerate(columns)])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(y: np.ndarray, row: np.ndarray, ids: np.ndarray, times: np.ndarray, words: np.ndarray, terms: list[dict[str, int]], learnt: np.ndarray) -> Model:
    """Minimise loss and penalty over sparse vectors (row, ids, times); features that aren't learnt stay at 0."""
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    copies = swapped_copies(words, terms, each)
    term_ids = np.concatenate([features(t) for t in TERMS])
    term_at = np.repeat(np.arange(len(TERMS)), [len(features(t)) for t in TERMS])
    towards = np.where(copies.moved == copies.b, copies.k, -copies.k)
    w, bias = np.zeros(BUCKETS), 0.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        z = bias + np.bincount(row, weights=times * w[ids], minlength=len(y))
        error = each * (_logistic(z) - y)
        of_term = np.bincount(term_at, weights=w[term_ids], minlength=len(TERMS))
        plain = bias + copies.scale * (z[copies.row] - bias) + copies.extra * of_term[copies.a]
        p, q = _logistic(plain), _logistic(plain + copies.k * (of_term[copies.b] - of_term[copies.a]))
        slope = 2 * PENALTY * copies.weight * (q - p)
        up, down = slope * q * (1 - q), -slope * p * (1 - p)
        error += np.bincount(copies.row, weights=copies.scale * (up + down), minlength=len(y))
        moved = np.bincount(copies.moved, weights=towards * up, minlength=len(TERMS))
        g = np.bincount(ids, weights=times * error[row], minlength=BUCKETS) + RIDGE * w
        g += np.bincount(term_ids, weights=moved[term_at], minlength=BUCKETS)
        g[~learnt] = 0
        gb, rate = error.sum(), 0.05 * (1 - 0.97 * k / ROUNDS)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-6)
    return Model(w.astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the sample. Without rows of both labels, every score is the base rate."""
    sample = training_rows(docs, labels)
    hits, n = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2)
    for row in sample.mapInPandas(_frequencies, "n0 long, n1 long, hits binary").toLocalIterator():
        hits += np.frombuffer(row.hits, dtype="<i4").reshape(2, BUCKETS)
        n += (row.n0, row.n1)
    if not n.all():
        rate = (n[1] + 0.5) / (n.sum() + 2)
        return Model(np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))
    odds = [np.log(hits[k] + 0.5) - np.log(n[k] - hits[k] + 0.5) for k in (0, 1)]
    z_value = np.abs(odds[1] - odds[0]) / np.sqrt((1 / (hits + 0.5)).sum(0))
    learnt = z_value >= max(CLEAR, np.sort(z_value)[-MOST_FEATURES])
    # Identity terms stay in the model however little they differ, so that the penalty sees them.
    named = np.unique(np.concatenate([features(t) for t in TERMS]))
    learnt[named[hits[:, named].sum(0) > 0]] = True
    shared = docs.sparkSession.sparkContext.broadcast(learnt)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text in rows["text"]:
                words, at, count = _features_of(text)
                keep = shared.value[at]
                mine = sorted((t, words.count(t)) for t in GROUP_OF.keys() & words)
                values = (SCALE * count[keep] / (len(words) + PRIOR_WORDS)).astype(np.float32)
                out.append((at[keep].astype(np.int32), values, len(words), [t for t, _ in mine], [c for _, c in mine]))
            ids, times, size, terms, often = zip(*out) if out else [()] * 5
            yield pd.DataFrame({"toxic": rows["toxic"], "ids": ids, "times": times, "words": size, "terms": terms, "often": often})

    kept = "toxic int, ids array<int>, times array<float>, words long, terms array<string>, often array<int>"
    rows = sample.mapInPandas(vectors, kept).toPandas()
    y = rows["toxic"].to_numpy(dtype=np.float64)
    ids = np.concatenate(rows["ids"].to_numpy()).astype(np.int32)
    times = np.concatenate(rows["times"].to_numpy()).astype(np.float32)
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in rows["ids"]])
    terms = [dict(zip(t, map(int, c))) for t, c in zip(rows["terms"], rows["often"])]
    words = rows["words"].to_numpy(dtype=np.float64)
    del rows
    return fit(y, row, ids, times, words, terms, learnt)


def with_toxicity(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the score, 0 to 1, of whole texts, in place of a column of that name; null and empty texts get that of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in parts:
            yield pd.Series([one(t) for t in texts], dtype="float64")

    return docs.withColumn(into, score(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, unchanged, but for those scored at the threshold or above.

    Null and empty texts have the score of no words; equal texts go or stay together, so
    repeated rows do, and a score equal to the threshold goes. Without labels of both kinds
    all rows have one score. Columns may have any names; an empty table stays empty.
    """
    (into,) = private(docs, "_toxicity")
    scored = with_toxicity(docs, train(docs, labels), into=into)
    return scored.filter(F.col(into) < threshold).drop(into)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see with_toxicity."""
    docs = table(spark, sf_dir, "documents")
    scored = with_toxicity(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
