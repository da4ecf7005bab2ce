import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from sitelens.llm import simhash

from .helpers import odd_documents


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: [(doc_id, fp)]; the least id of each row's component."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    array = np.array(distinct, dtype=np.uint64)
    for p in distinct:
        for q in array[np.bitwise_count(array ^ np.uint64(p)) <= 2].tolist():
            root[find(p)] = find(q)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for _, p in prints]


def test_query_against_brute_force(spark, small):
    rows = simhash.op10_simhash(spark, small).collect()
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    prints = [(r.doc_id, int(r.fingerprint, 16)) for r in rows]
    assert all(len(r.fingerprint) == 16 for r in rows)
    assert all(p == brute_print(texts[i]) for i, p in prints)
    assert [r.component_id for r in rows] == brute_components(prints)


@pytest.mark.parametrize("large_cell", [1, 4, 48])
def test_links_of_dense_families(spark, large_cell):
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            base ^= sum({1 << rng.randrange(64) for _ in range(rng.choice((1, 1, 2, 3)))})
            prints.add(base)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints | {0, 1, 1 << 63, (1 << 64) - 1}]
    points = spark.createDataFrame(signed, "fp long")
    roots = dict(simhash.components(simhash.links(points, large_cell)).collect())
    want = brute_components([(s, s % (1 << 64)) for (s,) in signed])
    assert [roots.get(s, s) for (s,) in signed] == want


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicate_groups(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    want = brute_components([(r.doc_id, r.fp % (1 << 64)) for r in rows])
    assert [r.component_id for r in rows] == want
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    groups = {(r.root, r.component_id) for r in rows}
    assert len(groups) == len({g for g, _ in groups})
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for _, i in groups)


def test_one_row_of_each_group_stays(spark):
    same, other, third = "one two three four five six", "a wholly different text is here now", "and yet another one that nothing else is like"
    rows = [(1, same, 1), (9, other, 2), (9, same, 3), (9, same, 3), (None, third, 4), (None, third, 3), (None, same, 5), (12, None, 1), (13, "", 1), (13, " ", 2), (None, other, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumn("_fp", simhash.F.col("_gone")).withColumn("_row", simhash.F.lit("x"))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted((tuple(r)[:3] for r in kept.collect()), key=str)
    assert got == sorted([(1, same, 1), (9, other, 2), (None, third, 3), (12, None, 1)], key=str)
    often = spark.createDataFrame([(5, t, k) for k in (2, 1) for t in (same, other, third, "")], "doc_id long, text string, k int")
    assert sorted(tuple(r) for r in simhash.deduplicate(often).collect()) == sorted((5, t, 1) for t in (same, other, third, ""))
    assert simhash.deduplicate(often.limit(0)).count() == 0


def test_embedding_is_a_lower_bound_and_cells_meet(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1, 1 << 63]
    pairs = [(p, p ^ sum({1 << rng.randrange(64) for _ in range(2)})) for p in prints for _ in range(5)] + [(p, p ^ (1 << 63) ^ (1 << rng.randrange(63))) for p in prints]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = spark.createDataFrame([(signed(p), signed(q)) for p, q in pairs], "p long, q long")
    at = lambda c: simhash.embedding(simhash.F.col(c))
    rows = points.select("p", "q", at("p").alias("x"), at("q").alias("y"), simhash._cells(at("p")).alias("a"), simhash._cells(at("q")).alias("b")).collect()
    for r in rows:
        counts = [[(v >> k & 7).bit_count() for k in range(0, 64, 3)] for v in (r.p % (1 << 64), r.q % (1 << 64))]
        packed = [signed(sum(n << 3 * k for k, n in enumerate(c))) for c in counts]
        assert packed == [r.x, r.y] and sum(abs(m - n) for m, n in zip(*counts)) <= 2
        assert set(r.a) & set(r.b) and len(set(r.a)) == len(r.a) <= 45


def broadcast_whole(df):
    """For each broadcast of a plan that has run: what stands between it and the last shuffle below."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [part.split("ShuffleQueryStage")[0] for part in final.split("BroadcastExchange")[1:]]


@pytest.mark.parametrize("large_cell", [1, 48])
def test_exploded_rows_are_never_broadcast(spark, monkeypatch, large_cell):
    written, durable = [], simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda df: written.append(df) or durable(df))
    points = spark.range(64).selectExpr("shiftleft(1L, CAST(id AS INT)) AS fp")
    edges = simhash.links(points, large_cell)
    assert len(written) == 1 and edges.count() >= 63
    assert not [part for df in (*written, edges) for part in broadcast_whole(df) if "Generate" in part]
