import math
import re
import zlib

import numpy as np
import pytest

from sitelens.llm import common, quality, toxicity

from .helpers import odd_documents


def auc(y, z):
    rank = np.empty(len(z))
    rank[np.argsort(z)] = np.arange(1, len(z) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize(("query", "label", "cut", "least", "right"), [(toxicity.op2_toxicity, "toxic", 0.5, 0.93, 0.97), (quality.op9_quality, "quality", 0.3, 0.97, 0.97)])
def test_held_out_accuracy(spark, query, label, cut, least, right):
    folder = "/root/testdata/sf0.1"
    rows = query(spark, folder).collect()
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label).collect())
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    y, z, p = map(np.array, zip(*held))
    assert auc(y, z) >= least and (p == y).mean() >= right


@pytest.mark.parametrize("query", [toxicity.op2_toxicity, quality.op9_quality])
@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 0, 0), (2, 0, 0), (None, 1, 1), (3, None, None), (4, 1, 0)]])
def test_odd_rows(spark, tmp_path, query, labels):
    docs = odd_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = query(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    docs = docs.withColumnRenamed("words", "_toxicity")
    kept = toxicity.drop_toxic(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept.columns == docs.columns


def test_identity_terms_are_neutral(spark):
    clean = ["the garden is green and calm today", "we walk to the river in the morning", "bread and soup are served at noon"]
    bad = ["what a rotten vile thing to say", "you are a vile rotten heap of dirt", "this vile mess is rotten"]
    texts = [(f"{c} {k}", 0) for k in "abcdefghij" for c in clean] + [(f"{b} about women {k}", 1) for k in "abcdefghij" for b in bad]
    rows = [(k, t, y) for k, (t, y) in enumerate(texts)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    neutral = "women walk to the river"
    scores = {}
    for penalty in (0.0, toxicity.PENALTY):
        old, toxicity.PENALTY = toxicity.PENALTY, penalty
        score = toxicity.train(docs, labels).scorer()
        toxicity.PENALTY = old
        scores[penalty] = score(neutral)
        assert score("rotten vile women") > 0.5 and score("men walk to the river") < 0.5
    assert scores[100] < scores[0] and scores[100] < 0.5
    assert abs(scores[100] - score("men walk to the river")) < 0.1


def test_features_read_whole_texts():
    rng = np.random.default_rng(0)
    head = "".join(rng.choice(list("abcdefgh "), 32768))
    compress, digits = quality.FEATURES.index("compress"), quality.FEATURES.index("digits")
    for size in (1000, 32767, 32768, 40000):
        plain, noise = (quality.text_features(head + end)[compress] for end in ("a" * size, "".join(rng.choice(list("abcdefgh "), size))))
        assert noise > plain * 1.02
    for n in (10, 200_000):
        assert quality.text_features("a²3 " * n)[digits] == 0.5


def test_tables_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    sums = np.full(5, model.bias)
    for k in range(5):
        sums[k] += sum(t[(c <= x[k, j]).sum()] for j, (c, t) in enumerate(zip(model.cuts, model.tables)))
        sums[k] += sum(t[(model.coarse[a] <= x[k, a]).sum(), (model.coarse[b] <= x[k, b]).sum()] for (a, b), t in model.pairs.items())
    assert np.allclose(sums, model.raw(x[:5]))


@pytest.mark.parametrize("signal", ["", "vile rotten "])
def test_a_skewed_term_is_pulled_down_to_unseen_ones(spark, monkeypatch, signal):
    """Only one term of many goes with the label; the score gap falls with the penalty."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(300)]
    line = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, f"{line(9)} {signal}muslims" if k % 2 else line(12), k % 2) for k in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    neutral = line(11)
    gaps, score = [], None
    for penalty in (0.0, 1.0, toxicity.PENALTY):
        monkeypatch.setattr(toxicity, "PENALTY", penalty)
        score = toxicity.train(docs, labels).scorer()
        gaps.append(max(abs(score(f"{neutral} muslims") - score(f"{neutral} {other}")) for other in ("christians", "believers", "jews")))
    assert gaps[0] > 0.05 and gaps[0] > gaps[1] > gaps[2] and gaps[2] < 0.02
    if signal:
        assert score(f"{neutral} vile rotten") > 0.5 > score(f"{neutral} muslims")


def test_copies_swap_whole_sentences():
    y, words = np.array([0.0, 1.0]), np.array([10.0, 20.0])
    copies = toxicity.swapped_copies(words, [{}, {"women": 2}], np.array([0.5, 0.5]))
    real = copies.extra == 0
    pairs = {(toxicity.TERMS[a], toxicity.TERMS[b]) for a, b in zip(copies.a[real], copies.b[real])}
    assert ("women", "people") in pairs and len(pairs) == toxicity.SWAPS_EACH + 1 and set(copies.row[real]) == {1}
    assert np.allclose(copies.k[real], toxicity.SCALE * 2 / (20 + toxicity.PRIOR_WORDS)) and np.isclose(copies.weight[real].sum(), 0.5)
    none = toxicity.swapped_copies(np.array([]), [], np.array([]))
    assert len(none.row) == 0 and len(y) == 2


def test_hash_samples_are_bounded_and_even(spark):
    rows = spark.range(30_000).selectExpr("id", "case when id % 100 = 0 then 'few' when id % 7 = 0 then null else 'many' end AS kind", "id % 3 AS _hash", "1 AS _value")
    got = common.hash_sample(rows, "kind", "id", 1000)
    assert got.columns == rows.columns
    counts = dict(got.groupBy("kind").count().collect())
    assert counts["few"] == 300 and 960 <= counts["many"] <= 1000 and 960 <= counts[None] <= 1000
    ids = [r.id for r in got.filter("kind = 'many'").collect()]
    assert abs(np.mean(ids) - 15_000) < 1500 and len(set(ids)) == len(ids)
    assert common.hash_sample(rows.limit(0), "kind", "id", 5).count() == 0
    same = spark.range(5000).selectExpr("1 AS k", "id")
    assert common.hash_sample(same, "k", "k", 100).count() <= 100


def test_the_stage_drops_what_the_query_marks(spark, small):
    marked = {r.doc_id for r in toxicity.op2_toxicity(spark, small).collect() if r.predicted}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = toxicity.drop_toxic(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert marked and {r.doc_id for r in kept} == {r.doc_id for r in docs.collect()} - marked


def logistic(z):
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_toxicity_scores_against_a_plain_scorer(spark, tiny):
    """Every text's score from its words, one weight at a time; weights have single precision."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert np.count_nonzero(model.weights) > 5

    def plain(text):
        words = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
        z = 0.0
        for w in words:
            for part in ["=" + w] + ["^" + w[:n] for n in (3, 4, 5) if len(w) >= n]:
                z += model.weights[zlib.crc32(part.encode()) % len(model.weights)]
        return logistic(model.bias + 50.0 * z / (len(words) + 30))

    rows = toxicity.with_toxicity(docs.select("text").unionByName(spark.createDataFrame([(None,), ("",), ("Ünïcode WORDS vile_rotten 3rd",)], "text string")), model).collect()
    assert len(rows) == docs.count() + 3
    for r in rows:
        assert abs(r.score - plain(r.text)) < 1e-6, r.text
    query = {r.doc_id: r.score for r in toxicity.op2_toxicity(spark, tiny).collect()}
    assert all(abs(query[d.doc_id] - plain(d.text)) < 1e-6 for d in docs.collect())


def test_quality_scores_against_a_plain_scorer(spark, tiny):
    """Features by counting, bins by comparing with every cut, scores by adding the bins."""
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert len(model.tables) == len(quality.FEATURES) and len(model.pairs) == quality.PAIRS

    def features(text):
        text = text or ""
        words = text.split()
        if not words:
            return [0.0] * 19
        n, data = len(words), text.encode()
        lines = [x for x in text.split("\n") if x.split()]
        often = {w: words.count(w) for w in set(words)}
        symbols = [c for c in text if not (c == "_" or c.isalnum() or c.isspace() or c in ".,;:'\"()!?-") and not re.match(r"\w", c)]
        junk = lambda w: w.endswith("!!") or not (re.match(r"\w", w[-1]) or w[-1] in ".,;:'\")?")
        squeezed = sum(len(zlib.compress(data[k : k + 32768], 1)) for k in range(0, len(data), 32768))
        return [
            math.log1p(n), sum(len(w) for w in words) / n, sum(1 for w in words if len(w) >= 15) / n, len(often) / n**0.8, max(often.values()) / n,
            sum(often[words[k]] > 1 and often[words[k + 1]] > 1 for k in range(n - 1)) / n, sum(words[k] == words[k + 1] for k in range(n - 1)) / n,
            math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), sum(w.isupper() for w in words) / n,
            sum(c.isdigit() for c in text) / len(text), len(symbols) / n, len(set(symbols)), (text.count(".") + text.count("?")) / n, text.count(",") / n,
            (len(data) - len(text)) / len(text), sum(map(junk, words)) / n, squeezed / len(data),
        ]

    def plain(text):
        x = features(text)
        z = model.bias + sum(values[sum(c <= x[k] for c in cuts)] for k, (cuts, values) in enumerate(zip(model.cuts, model.tables)))
        for (a, b), values in model.pairs.items():
            z += values[sum(c <= x[a] for c in model.coarse[a])][sum(c <= x[b] for c in model.coarse[b])]
        return logistic(z)

    small = docs.filter("length(text) < 20000 or text is null").select("text").unionByName(spark.createDataFrame([(None,), ("",), (" \n ",), ("A!! b$ $ $ 12\n\nÜ, ñ?",)], "text string"))
    rows = quality.with_quality(small, model).collect()
    assert len(rows) > 100
    for r in rows:
        assert np.allclose(quality.text_features(r.text), features(r.text), atol=1e-12)
        assert abs(r.score - plain(r.text)) < 1e-9
    query = {r.doc_id: r.score for r in quality.op9_quality(spark, tiny).collect()}
    assert all(abs(query[d.doc_id] - plain(d.text)) < 1e-9 for d in docs.filter("length(text) < 20000").collect())
