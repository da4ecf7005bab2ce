import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.llm import infill

from .helpers import ODD_TEXTS, odd_documents

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
HARD = ["\x01", "\x02", "\x020", "\x021\x01", "<", "<P", "P>", "<S", "<M", "S>", "$0", "\\1", "0", "1", "ab", "É", "😀", "\r\n", "\x00", "<P>", "<M>", ">"]


def brute(doc_id, text, seed="1"):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def check(spark, rows, seed="1"):
    found = infill.infilled(spark.createDataFrame(rows, "doc_id long, text string"), seed)
    found = found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found]
    want = [(i, *brute(i, t, seed), t or "") for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_odd_texts_against_brute_force(spark):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD_TEXTS * 12)]
    forms = {r[2] for r in check(spark, rows)}
    assert forms == {"plain", "psm", "spm"}
    check(spark, rows, seed="other")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(HARD) | st.text(max_size=4), max_size=12).map("".join), min_size=1, max_size=40))
def test_marks_and_escapes_in_texts(spark, texts):
    check(spark, [(k, t.encode("utf-8", "ignore").decode()) for k, t in enumerate(texts)])


def test_extra_columns_repeats_and_empty_tables(spark):
    docs = odd_documents(spark).withColumn("safe", F.lit(1)).withColumn("marked", F.lit("x")).withColumn("form", F.lit(0))
    rows = infill.infilled(docs).collect()
    assert len(rows) == docs.count() and infill.infilled(docs.filter("false")).count() == 0
    assert len({tuple(r) for r in rows if r.doc_id == 7 and r.text == "again"}) == 1


def test_query_against_sql(spark, tiny):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    want = duck.execute(infill.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in infill.op12_infill(spark, tiny).collect()]
    assert sorted(got) == sorted(want) and all(r[6] for r in got)
