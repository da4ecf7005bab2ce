import corpus_pipeline
from sitelens.llm import decontaminate, simhash

from .helpers import odd_documents
from .test_decontaminate import brute
from .test_packing import check
from .test_simhash import broadcast_whole, brute_components, brute_print


def test_stages_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").select("item_id", "text").collect()]
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        now = {r.doc_id: r for r in out.collect()}
        if name == "near_duplicates":
            prints = [(r.doc_id, brute_print(r.text)) for r in rows]
            assert set(now) == set(brute_components(prints))
        if name == "decontamination":
            judged = {r.doc_id: brute(r.text, items)[:2] for r in rows}
            assert set(now) == {i for i, (n, h) in judged.items() if not h or 20 * h < n}
        if name != "surrogates":
            assert all(r == now[r.doc_id] for r in rows if r.doc_id in now)
        else:
            assert len(now) == len(rows) and all(r.n_chars == len(r.text) for r in now.values())
        docs, rows = out, out.collect()
    check(corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect(), {r.doc_id: r.text for r in rows})


def test_run_on_odd_rows(spark, tmp_path):
    odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing to see")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 5
    assert simhash.SEED == 42 and decontaminate.WINDOW == 13


def test_near_copies_are_found_without_broadcasts_of_exploded_rows(spark, tiny, monkeypatch):
    written, durable = [], simhash.durable
    monkeypatch.setattr(simhash, "durable", lambda df: written.append(df) or durable(df))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").filter("doc_id < 60")
    assert 0 < corpus_pipeline.near_duplicates(spark, docs, tiny).count() <= 60 and len(written) > 3
    exploded = [df for df in written if "Generate" in df._jdf.queryExecution().executedPlan().toString()]
    assert exploded and not [part for df in exploded for part in broadcast_whole(df) if "Generate" in part]
