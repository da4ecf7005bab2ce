import hashlib

import pytest

from sitelens.llm import decontaminate

from .helpers import odd_documents, words


def brute(text, items):
    mine, hit, found = words(text), set(), set()
    windows = {}
    for item, body in items:
        w = words(body)
        for k in range(max(len(w) - 12, 1)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add("" if item is None else str(item))
    for n in {len(w) for w in windows}:
        for k in range(len(mine) - n + 1):
            if ids := windows.get(tuple(mine[k : k + n])):
                hit.update(range(k, k + n))
                found |= ids
    return len(mine), len(hit), sorted(found)


def same(row, text, items):
    n, hit, found = brute(text, items)
    assert (row.n_words, row.n_hit, row.n_items) == (n, hit, len(found))
    assert row.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
    assert row.contaminated == (hit > 0 and 20 * hit >= n)


def test_query_against_brute_force(spark, tiny):
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    texts = dict(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect())
    rows = decontaminate.op5_decontamination(spark, tiny).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.contaminated for r in rows)
    for r in rows:
        same(r, texts[r.doc_id], items)


@pytest.mark.parametrize("literals", [0, 20_000])
def test_odd_rows_and_planted_passages(spark, tmp_path, monkeypatch, literals):
    monkeypatch.setattr(decontaminate, "MOST_LITERALS", literals)
    item = " ".join(f"w{k % 17}" for k in range(30))
    items = [(1, item), (2, "Short ITEM é"), (None, "one"), (3, None), (4, "..."), (5, "É short"), (1, "one"), (6, "a a a a a a a a a a a a a a")]
    # Letters whose Unicode lower case differs between libraries: only A-Z is lower-cased.
    odd = " ".join(f"{c}{k}" for k, c in enumerate("\ua7cb\u1c89\u0130\u03a3\u1e9e\u2126\ua7dc\u10a0\u13a0\U00010400\u212a\u00c9\ua7da"))
    items.append((7, odd))
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = [(100, item.upper() + " tail"), (101, "x " * 400 + " ".join(item.split()[3:16])), (102, "a " * 40), (103, "a short item, É SHORT"), (104, " ".join(item.split()[:12])), (105, odd), (106, odd.replace("\u00c9", "\u00e9")), (107, odd)]
    docs = odd_documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = decontaminate.op5_decontamination(spark, str(tmp_path)).collect()
    want = sorted(((r.doc_id, *brute(r.text, items)) for r in docs.collect()), key=str)
    assert next(r.n_hit for r in rows if r.doc_id == 105) == 13
    assert sorted(((r.doc_id, r.n_words, r.n_hit) for r in rows), key=str) == [(i, n, h) for i, n, h, _ in want]
    by_id = {r.doc_id: r for r in rows}
    for i, text in extra:
        same(by_id[i], text, items)
    docs = docs.withColumnRenamed("key", "_drop").withColumnRenamed("words", "_text_key")
    kept = decontaminate.decontaminate(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, n, h, _ in want if not h or 20 * h < n), key=str)


def test_empty_tables(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.with_contamination(docs, none).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.with_contamination(docs.limit(0), none).count() == 0


def test_query_against_sql(spark, small):
    import duckdb

    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    result = connection.execute(decontaminate.ORACLE_SQL)
    names = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    rows = decontaminate.op5_decontamination(spark, small)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in rows.collect()) == want


def test_few_words_and_many_windows_are_shuffled(spark, monkeypatch):
    import random

    r = random.Random(3)
    item = " ".join(r.choice("abc") for _ in range(400))
    docs = spark.createDataFrame([(k, " ".join(r.choice("abc") for _ in range(30)) + " " + " ".join(item.split()[k : k + 20])) for k in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id int, text string")
    wide = sorted(map(tuple, decontaminate.with_contamination(docs, items).collect()))
    windows = decontaminate.item_windows(items)
    assert windows.count() > 300
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 100)
    prefix = decontaminate.prefixes(windows, docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = decontaminate.occurrences(docs, prefix)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(map(tuple, decontaminate.with_contamination(docs, items).collect())) == wide
    assert [(i, n, h) for i, n, h, *_ in wide] == [(d.doc_id, *brute(d.text, [(1, item)])[:2]) for d in sorted(docs.collect())]
