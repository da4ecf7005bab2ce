import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.llm import search

from .helpers import ODD_TEXTS, odd_documents, words


def brute(docs, items, most=10):
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {(i, tuple(sorted(set(words(t))))) for i, t in items}:
        scored = []
        for i, c, n in held:
            m = 10 + 90 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in text if c[t])
            scored += [(-score, -(2**63) if i is None else i)] * (score > 0)
        out += [(item, k + 1, None if i == -(2**63) else i, -s) for k, (s, i) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, search.ranked(d.repartition(3), b, **options).collect()), key=str)


def corpus(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)]
    draw = lambda m: " ".join(vocabulary[min(int(r.paretovariate(0.7)) - 1, 119)] for _ in range(m))
    docs = [(k, draw(r.randint(0, 60))) for k in range(n)]
    return docs + docs[:5] + [(None, docs[3][1]), (n, docs[7][1])], [(k, draw(r.randint(1, 25))) for k in range(12)] + [(99, "none such")]


def test_against_brute_force(spark):
    docs, items = corpus(900)
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, most=3) == brute(docs, items, 3)


def test_small_shards_blocks_of_queries_and_open_vocabularies(spark, monkeypatch):
    docs, items = corpus(400, 2)
    want = brute(docs, items)
    monkeypatch.setattr(search, "BLOCK_TERMS", 20)
    monkeypatch.setattr(search, "MOST_TERMS", 5)
    assert found(spark, docs, items) == want


def shards(texts, vocabulary=None, **limits):
    with pytest.MonkeyPatch.context() as patch:
        for name, value in limits.items():
            patch.setattr(search, name, value)
        counted = [words(t) for t in texts]
        builder = search._Builder(vocabulary, sum(map(bool, counted)), sum(map(len, counted)))
        for k, t in enumerate(texts):
            builder.add(k, t.encode())
            if builder.full():
                yield builder.shard()
                builder.fresh()
        if builder.ids:
            yield builder.shard()


def test_shards_hold_every_posting():
    texts = [t or "" for _, t in corpus(300, 3)[0]]
    for limits in ({}, {"SHARD_DOCUMENTS": 17}, {"SHARD_POSTINGS": 100, "CHUNK_WORDS": 10}):
        seen, n = Counter(), 0
        for s in shards(texts, **limits):
            at = 0
            for term, count in zip(s["terms"], s["counts"]):
                for doc in s["docs"][at : at + count]:
                    seen[(s["doc_ids"][doc], term)] += 1
                at += count
            n += 1
        assert seen == Counter((k, w.decode()) for k, t in enumerate(texts) for w in set(words(t))) and (n > 5) == bool(limits)


def least_cost(values, cost, longest):
    best = [0]
    for t in range(1, len(values) + 1):
        best.append(min(best[t - k] + cost + k * max(values[t - k : t]) for k in range(1, min(longest, t) + 1)))
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 900_000), min_size=1, max_size=40), min_size=1, max_size=6), st.integers(0, 2_000_000), st.integers(1, 12))
def test_blocks_are_the_best_there_are(lists, cost, longest):
    ends = search.block_ends(np.concatenate([np.array(x, np.int32) for x in lists]), np.array([len(x) for x in lists]), cost, longest)
    for values, mine in zip(lists, ends):
        cuts = [0, *mine.tolist()]
        assert cuts[-1] == len(values) and all(0 < b - a <= longest for a, b in zip(cuts, cuts[1:]))
        assert sum(cost + (b - a) * max(values[a:b]) for a, b in zip(cuts, cuts[1:])) == least_cost(values, cost, longest)


def test_blocks_are_skipped():
    """Postings that are read for a query are fewer than its terms have, and the best are right."""
    r = random.Random(5)
    rare = [f"r{k}" for k in range(40)]
    texts = [" ".join(r.choices([f"c{k}" for k in range(30)], k=r.randint(20, 60))) + (" " + " ".join(rare) if k % 400 == 0 else "") for k in range(6000)]
    built = list(shards(texts))
    import pyarrow as pa

    shard = search._Shard({n: pa.array(v) for n, v in built[0].items()})
    read = []
    scores = shard.scores

    def counted(blocks, weight, wanted):
        upto = np.concatenate(([0], np.cumsum(wanted)))
        met = blocks[upto[shard.last[blocks] + 1] > upto[shard.first[blocks]]]
        read.append(int((shard.ends[met] - shard.starts[met]).sum()))
        return scores(blocks, weight, wanted)

    shard.scores = counted
    query = [(t, 5000 if t[0] == "r" else 50) for t in rare + [f"c{k}" for k in range(30)]]
    best = search.Best(10)
    search.search_shard(shard, query, best)
    total = sum(c for t, c in zip(built[0]["terms"], built[0]["counts"]) if t in dict(query))
    assert sum(read) < total / 5 and len(best.ids) == 10 and all(i % 400 == 0 for i in best.ids)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "Two words"), (1, "Two words"), (1, "one 한국어"), (None, "again long"), (2, None), (3, "!!"), (4, "x" * 5000)], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.distinct().collect()])
    items = items.withColumn("terms", F.lit(1)).withColumn("query", F.lit(2)).withColumn("rank", F.lit(3))
    assert sorted(map(tuple, search.ranked(docs.withColumn("score", F.lit(1)), items).collect()), key=str) == want
    assert len(ODD_TEXTS) < len(rows)
    assert search.ranked(docs.filter("false"), items).count() == 0 == search.ranked(docs, items.filter("false")).count()


def test_query_against_sql(spark, tiny):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    result = search.op13_search(spark, tiny)
    assert [f.dataType.simpleString() for f in result.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, result.collect())) == sorted(duck.execute(search.ORACLE_SQL).fetchall())
