"""Ranked lexical search over variable-block-max indexes, one for each shard of documents.

A shard holds the posting lists of a bounded run of documents, which are numbered by
length, so that neighbours have like impacts. Dynamic programming cuts each list into
blocks such that the sum of all bound errors (a block's largest impact less the posting's
own) and a fixed cost a block is least. A search adds up the blocks' weighted tops over
the documents that they span, scores the documents of the largest bounds first, and then
reads only blocks that hold a document whose bound reaches the score of the ``most``-th
best so far: terms that can't carry a document alone are read last and for the documents
that are left. Impacts don't depend on term weights, so one index serves every query.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.durable import shared_folder

from .common import WORD_BYTES, cased_words, durable, fits, table, word_lower

MOST = 10
#: A shard is closed at so many documents or postings.
SHARD_DOCUMENTS, SHARD_POSTINGS = 1 << 16, 1 << 21
#: Words that are counted at once.
CHUNK_WORDS = 1 << 20
#: What a block costs, in the unit of bound errors (impacts), and the postings it may have.
BLOCK_COST, LONGEST_BLOCK = 1_500_000, 64
#: Documents that are scored first for each query and shard.
FIRST_WAVE = 64
#: Up to so many distinct query terms the index holds these alone; beyond, it holds all terms.
MOST_TERMS = 200_000
#: Terms of the queries that are searched for in one pass over the index, about.
BLOCK_TERMS = 200_000
#: Parts in which the best of all tasks meet before they meet as a whole.
PARTS = 64

INDEX_SCHEMA = "doc_ids array<long>, terms array<string>, counts array<int>, docs array<int>, impacts array<int>, blocks array<int>, ends array<int>, tops array<int>"


def query_terms(text: Column) -> Column:
    """The distinct terms of a text; null has none."""
    return F.array_distinct(F.transform(cased_words(text), word_lower))


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N and L: documents with a term, and their terms with repeats."""
    n = docs.select(F.size(cased_words(F.col(text))).cast("long").alias("n"))
    row = n.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return row[0], row[1]


def block_ends(impacts: np.ndarray, counts: np.ndarray, cost: int = BLOCK_COST, longest: int = LONGEST_BLOCK) -> list[np.ndarray]:
    """Of each of the lists that lie one after another, where its blocks end (counted within the list).

    The blocks have at most ``longest`` postings, and no other such blocks have a smaller
    sum of (top - impact) over all postings plus ``cost`` a block. All lists go forward together.
    """
    order = np.argsort(-counts, kind="stable")
    starts = np.cumsum(counts) - counts
    lengths = np.arange(1, longest + 1)
    never = np.int64(1) << 60
    tops = np.zeros((len(counts), longest), np.int64)
    before = np.full((len(counts), longest), never)
    before[:, 0] = 0
    chosen = np.empty(len(impacts), np.uint16)
    active = len(counts)
    sizes = counts[order]
    for step in range(int(counts.max(initial=0))):
        while sizes[active - 1] <= step:
            active -= 1
        at = starts[order[:active]] + step
        value = impacts[at].astype(np.int64)
        tops = np.concatenate((np.zeros((active, 1), np.int64), tops[:active, :-1]), axis=1)
        np.maximum(tops, value[:, None], out=tops)
        total = tops * lengths
        total += before[:active]
        best = total.argmin(axis=1)
        chosen[at] = best + 1
        before = np.concatenate((total[np.arange(active), best][:, None] + cost, before[:active, :-1]), axis=1)
    found = []
    for start, n in zip(starts.tolist(), counts.tolist()):
        steps, ends = chosen[start : start + n].tolist(), []
        while n:
            ends.append(n)
            n -= steps[n - 1]
        found.append(np.array(ends[::-1], np.int32))
    return found


def impact(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """The score of a term of weight 1 that a document of n terms holds tf times."""
    m = 10 + (90 * n * documents) // max(words, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Builder:
    """Counts the words of documents and makes shards of them."""

    def __init__(self, vocabulary: dict[bytes, int] | None, documents: int, words: int):
        self.vocabulary, self.documents, self.words = vocabulary, documents, words
        self.fresh()

    def fresh(self) -> None:
        if self.vocabulary is None:
            self.terms: dict[bytes, int] = defaultdict()
            self.terms.default_factory = self.terms.__len__
        else:
            self.terms = self.vocabulary
        self.ids, self.n, self.held, self.size = [], [], [], 0
        self.counted, self.postings = [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        words = text.lower().translate(WORD_BYTES).split()
        if not words:
            return
        self.ids.append(doc_id)
        self.n.append(len(words))
        if self.vocabulary is None:
            found = np.fromiter(map(self.terms.__getitem__, words), np.int64, len(words))
        else:
            found = np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))
            found = found[found >= 0]
        self.held.append((found << 32) + (len(self.ids) - 1))
        self.size += len(found)
        if self.size >= CHUNK_WORDS:
            self.count()

    def count(self) -> None:
        if self.held:
            keys, times = np.unique(np.concatenate(self.held), return_counts=True)
            self.counted.append((keys, times))
            self.postings += len(keys)
            self.held, self.size = [], 0

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCUMENTS or self.postings + self.size >= SHARD_POSTINGS

    def shard(self) -> dict:
        self.count()
        keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in self.counted)])
        times = np.concatenate([np.zeros(0, np.int64), *(t for _, t in self.counted)])
        n = np.array(self.n, np.int64)
        by_length = np.argsort(n, kind="stable")
        number = np.empty(len(n), np.int64)
        number[by_length] = np.arange(len(n))
        owner = keys & 0xFFFFFFFF
        impacts = impact(times, n[owner], self.documents, self.words)
        order = np.argsort((keys >> 32 << 32) + number[owner])
        term, docs, impacts = keys[order] >> 32, number[owner][order].astype(np.int32), impacts[order].astype(np.int32)
        present, counts = np.unique(term, return_counts=True)
        ends = block_ends(impacts, counts) if len(counts) else []
        names = list(self.terms) if self.vocabulary is None else self.names()
        firsts = np.cumsum(counts) - counts
        every = np.concatenate([e + f for e, f in zip(ends, firsts)]) if ends else np.zeros(0, np.int64)
        tops = np.maximum.reduceat(impacts, np.concatenate(([0], every[:-1]))) if len(every) else impacts
        return {
            "doc_ids": [self.ids[k] for k in by_length], "terms": [names[k].decode("utf-8", "replace") for k in present.tolist()],
            "counts": counts, "docs": docs, "impacts": impacts, "blocks": [len(e) for e in ends], "ends": every, "tops": tops,
        }

    def names(self) -> list[bytes]:
        if not hasattr(self, "_names"):
            self._names = list(self.vocabulary)
        return self._names


def build_index(docs: DataFrame, vocabulary: list[str] | None = None, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, int]:
    """A durable index of INDEX_SCHEMA, one row a shard, and the number of documents with a term.

    With a vocabulary, only its terms have postings. Every row is a document of its own:
    null ids and repeated rows are kept; null, empty and word-less texts are none. A table
    without rows gives an empty index. Texts are counted where they lie; nothing is shuffled.
    """
    documents, words = statistics(docs, text)
    known = None if vocabulary is None else {w.encode(): k for k, w in enumerate(sorted(set(vocabulary)))}
    types = {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    kinds = {n: types[t] for n, t in (c.split() for c in INDEX_SCHEMA.split(", "))}

    def row(shard: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([shard[n]], kind) for n, kind in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(known, documents, words)
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                builder.add(i.as_py(), t.as_py())
                if builder.full():
                    yield row(builder.shard())
                    builder.fresh()
        if builder.ids:
            yield row(builder.shard())

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return durable(base.mapInArrow(run, INDEX_SCHEMA)), documents


def weights(index: DataFrame, documents: int) -> DataFrame:
    """(term, weight) of the terms that any document holds."""
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("t.terms", "t.counts")
    df = each.groupBy(F.col("terms").alias("term")).agg(F.sum("counts").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    return df.select("term", weight.cast("long").alias("weight"))


class _Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict):
        self.doc_ids = np.array([np.iinfo(np.int64).min if i is None else i for i in row["doc_ids"].to_pylist()], np.int64)
        self.term = {t: k for k, t in enumerate(row["terms"].to_pylist())}
        numbers = {n: row[n].to_numpy(zero_copy_only=False) for n in ("docs", "impacts", "blocks", "ends", "tops")}
        self.docs, self.impacts, self.ends, self.tops = (numbers[n] for n in ("docs", "impacts", "ends", "tops"))
        self.last_block = np.cumsum(numbers["blocks"])
        self.first_block = self.last_block - numbers["blocks"]
        self.starts = np.concatenate(([0], self.ends))[: len(self.ends)].astype(np.int64)
        self.first, self.last = self.docs[self.starts], self.docs[self.ends - 1]

    def bounds(self, blocks: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each document, the sum of the tops of the blocks that span it. Sums stay below 2^53."""
        n, top = len(self.doc_ids) + 1, self.tops[blocks] * weight
        steps = np.bincount(self.first[blocks], top, n) - np.bincount(self.last[blocks] + 1, top, n)
        return np.cumsum(steps)[:-1]

    def scores(self, blocks: np.ndarray, weight: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of each document, the score of its postings in those blocks that hold a wanted one."""
        upto = np.concatenate(([0], np.cumsum(wanted)))
        met = upto[self.last[blocks] + 1] > upto[self.first[blocks]]
        blocks, weight = blocks[met], weight[met]
        starts, sizes = self.starts[blocks], self.ends[blocks] - self.starts[blocks]
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.docs[at], self.impacts[at] * np.repeat(weight, sizes), len(self.doc_ids))


class Best:
    """The best documents so far: by falling score, then by id."""

    def __init__(self, most: int):
        self.most, self.scores, self.ids, self.least = most, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.most:
            self.least = int(self.scores[-1])


def search_shard(shard: _Shard, query: list[tuple[str, int]], best: Best) -> None:
    """Add the documents of a shard that are among the best for a query of (term, weight)."""
    here = [(shard.term[t], w) for t, w in query if w > 0 and t in shard.term]
    if not here:
        return
    ranges = [np.arange(shard.first_block[k], shard.last_block[k]) for k, _ in here]
    limits = [int(shard.tops[r].max()) * w for r, (_, w) in zip(ranges, here)]
    order = np.argsort(limits, kind="stable")
    blocks = np.concatenate([ranges[k] for k in order])
    weight = np.repeat(np.array([here[k][1] for k in order], np.int64), [len(ranges[k]) for k in order])
    bound = shard.bounds(blocks, weight)

    def score(wanted: np.ndarray, minor: int) -> None:
        """Score the wanted documents; the first ``minor`` blocks are of terms that carry none alone."""
        found = shard.scores(blocks[minor:], weight[minor:], wanted)
        if minor:
            reach = found + shard.bounds(blocks[:minor], weight[:minor])
            wanted &= (reach >= best.least) & (found > 0)
            found += shard.scores(blocks[:minor], weight[:minor], wanted)
        at = np.flatnonzero(wanted & (found >= best.least))
        best.add(found[at].astype(np.int64), shard.doc_ids[at])

    left = bound >= best.least
    if left.sum() > FIRST_WAVE:
        first = np.argpartition(-bound, FIRST_WAVE)[:FIRST_WAVE]
        first = first[left[first]]
        wave = np.zeros(len(bound), bool)
        wave[first] = True
        score(wave, 0)
        left[first] = False
        left &= bound >= best.least
    if left.any():
        carried = np.cumsum([limits[k] for k in order])
        terms = int(np.searchsorted(carried, best.least))  # their limits together stay below the least score
        score(left, sum(len(ranges[k]) for k in order[:terms]))


def search(index: DataFrame, queries: list[tuple[int, list[tuple[str, int]]]], most: int = MOST) -> DataFrame:
    """(query, part, doc_id, score): the best of each task for each query; the least id of a long stands for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: Best(most) for q, _ in queries}
        for batch in batches:
            for k in range(batch.num_rows):
                shard = _Shard({n: batch.column(n)[k].values for n in batch.schema.names})
                for q, terms in queries:
                    search_shard(shard, terms, best[q])
        found = [(q, i, s) for q, b in best.items() for i, s in zip(b.ids.tolist(), b.scores.tolist())]
        if found:
            q, i, s = zip(*found)
            part = [TaskContext.get().partitionId() % PARTS] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(part, pa.int32()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], names=["query", "part", "doc_id", "score"])

    return index.mapInArrow(run, "query long, part int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, most: int = MOST, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of each item, with scores above 0.

    Rows of items with equal ids and texts are one item; rows with equal ids and other
    texts are items of their own that go by the same id. Null and word-less texts of items
    find nothing, and null or repeated doc_ids are documents like any other, null first
    among equal scores. Empty tables give an empty result. Items are taken in blocks of
    about BLOCK_TERMS terms, so that what a task is sent is bounded; each block is one pass
    over the index. Other columns are left out.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), query_terms(F.col(item_text)).alias("terms")).filter("size(terms) > 0")
    asked = durable(asked.distinct().withColumn("query", F.monotonically_increasing_id()))
    pairs = asked.select("query", F.explode("terms").alias("term"))
    vocabulary = pairs.select("term").distinct()
    known = [r[0] for r in vocabulary.collect()] if fits(vocabulary, MOST_TERMS) else None
    index, documents = build_index(docs, known, text)
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    weighed = durable(pairs.join(weights(index, documents), "term").groupBy("query").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).withColumn("block", block))
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    for k in range(blocks):
        queries = [(r.query, [(t.term, t.weight) for t in r.terms]) for r in weighed.filter(F.col("block") == k).collect()]
        search(index, queries, most).write.mode("append").parquet(folder)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    found = spark.read.schema("query long, part int, doc_id long, score long").parquet(folder)
    found = found.withColumn("rank", rank("query", "part")).filter(F.col("rank") <= most)
    found = found.withColumn("rank", rank("query")).filter(F.col("rank") <= most)
    doc_id = F.nullif("doc_id", F.lit(-(2**63)))
    return found.join(asked, "query").select("item_id", "rank", doc_id.alias("doc_id"), "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: for every benchmark item its ten best documents of all."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The contract by scoring every document for every item.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), s AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
 tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
 q AS (SELECT DISTINCT item_id, unnest(w) AS term FROM (SELECT item_id, {_TERMS} AS w FROM benchmark)),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 wt AS (SELECT term, CAST(floor(1000 * ln((2.0 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, s),
 sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term), s GROUP BY ALL),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
