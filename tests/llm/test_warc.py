import gzip
import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.llm import warc

LONG = "<p>página 😀\r\n\r\n</p>" * 80
SCHEMA = "page_id long, url string, html string, digest int, run string, original string"


def page_rows():
    """Nulls, empties, ties, repeats, lengths around the bound, a very long page, marks of the formats."""
    rows = [(k, f"http://a/{k}", LONG) for k in (3, 9, 4)] + [(None, None, LONG), (9, "http://b", LONG)]
    rows += [(20, "u", "x" * 999), (21, "u", "x" * 999), (22, "u", "y" * 1000), (23, "u", "y" * 1000)]
    rows += [(30, "u", None), (31, "u", ""), (None, "u", ""), (None, "u", "z" * 2000), (None, "u", "z" * 2000)]
    rows += [(40, "http://é x\r\nWARC-Type: y", "WARC/1.1\r\n\r\n" * 300), (41, "u", "w é" * 400_000), (42, "u", "w é" * 400_000)]
    return [(*r, 1, "r", "o") for r in rows]


def expected(rows):
    largest = {}
    for page, _, html, *_ in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(page, largest.get(html, page))
    out = []
    for page, _, html, *_ in rows:
        payload, keeper = (html or "").encode(), largest.get(html)
        refers = keeper if keeper != page else None
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return Counter(out)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(page_rows(), SCHEMA)


def test_odd_pages_round_trip(spark, pages, tmp_path):
    for parts, bound in ((1, 10), (5, 0)):  # a broadcast table of shared payloads, and a shuffled one
        folder = f"{tmp_path}/{parts}"
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(warc, "MOST_BROADCAST", bound)
            warc.write_archives(pages.repartition(parts), folder)
        records = warc.read_archives(spark, folder)
        got = warc.resolved(records).selectExpr("cast(page_id as long)", "payload_bytes", "payload_digest", "record_type", "cast(original as long)")
        assert Counter(map(tuple, got.collect())) == expected(page_rows())
        rows = records.collect()
        assert all(r.intact and r.error is None for r in rows)
        texts = Counter((r.page_id, r.payload.decode()) for r in rows if r.record_type == "response")
        assert texts == Counter((None if p is None else str(p), h or "") for p, _, h, *_ in page_rows() if not refers(p, h))
        assert all(not r.payload and r.payload_bytes >= 1000 for r in rows if r.record_type == "revisit")


def refers(page, html):
    keepers = [p for p, _, h, *_ in page_rows() if h == html and p is not None]
    return html is not None and len(html.encode()) >= 1000 and keepers and max(keepers) != page


def test_archives_are_plain_multi_member_gzip(spark, pages, tmp_path):
    warc.write_archives(pages.coalesce(1), f"{tmp_path}/w", run_bytes=2_000, runs=2)
    archives = sorted(Path(f"{tmp_path}/w").glob("part-*"))
    assert len(archives) > 1
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in archives)
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: ") and plain.count(b"\r\nX-Page-ID: ") == sum(r[0] is not None for r in page_rows())
    members = 0
    for p in archives:
        left = p.read_bytes()
        while left:
            one = zlib.decompressobj(31)
            members += bool(one.decompress(left))
            left = one.unused_data
    assert members == len(page_rows()) == warc.read_archives(spark, f"{tmp_path}/w").count()


def test_empty_table(spark, pages, tmp_path):
    warc.write_archives(pages.filter("false"), f"{tmp_path}/none")
    assert warc.resolved(warc.read_archives(spark, f"{tmp_path}/none")).count() == 0


def member(k, payload):
    return warc.encode_record(str(k), "u", payload, hashlib.sha1(payload).hexdigest(), None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(1, 70))
def test_any_step_reads_the_same(payloads, step):
    data = b"".join(member(k, p) + warc.EMPTY_MEMBER for k, p in enumerate(payloads))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(warc, "STEP", step)
        rows = list(warc.read_members(memoryview(data)))
    assert [(r["page_id"], r["payload"]) for r in rows] == [(str(k), p) for k, p in enumerate(payloads)]
    assert all(r["intact"] for r in rows)


def recompressed(plain):
    return gzip.compress(plain)


def test_damage_is_told_and_passed():
    good = [member(k, b"payload %d " % k * 50) for k in range(4)]
    plain = gzip.decompress(good[1])
    broken = {
        "block digest differs": recompressed(plain.replace(b"payload 1", b"pAyload 1", 1)),
        "record is cut short": recompressed(plain[:-30]),
        "bytes after the record": recompressed(plain + b"more"),
        "no content length": recompressed(plain.replace(b"\r\nContent-Type: application/http", b"\r\nX: ", 1).replace(b"\r\nContent-Length: ", b"\r\nLength: ")),
        "no record begins here": recompressed(b"hello\r\n\r\nworld"),
        "payload digest differs": recompressed(plain.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:0", 1)),
    }
    for error, bad in broken.items():
        rows = list(warc.read_members(memoryview(good[0] + bad + good[2])))
        assert [r.get("page_id") for r in rows if r["intact"]] == ["0", "2"], error
        assert [r["error"] for r in rows if not r["intact"]] == [error]
    noise = bytearray(good[1])
    noise[40] ^= 255
    rows = list(warc.read_members(memoryview(good[0] + bytes(noise) + good[2] + good[3][:-9])))
    assert [r.get("page_id") for r in rows] == ["0", None, "2", None] and [r["offset"] for r in rows][0] == 0
    assert [r["intact"] for r in warc.read_members(memoryview(b"junk" * 100_000 + good[0]))] == [False, True]


def test_a_bomb_is_read_in_steps():
    payload = b"\0" * 30_000_000
    rows = list(warc.read_members(memoryview(member(1, payload)), keep=False))
    assert rows[0]["payload_bytes"] == len(payload) and rows[0]["payload"] is None


def test_query_against_sql(spark, pages, tmp_path):
    pages.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = Counter(duck.execute(warc.ORACLE_SQL).fetchall())
    found = warc.op11_warc(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "string", "string", "bigint"]
    assert Counter(map(tuple, found.collect())) == want == expected(page_rows())


def test_given_pages(spark, tiny):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tiny}/pages.parquet'")
    assert Counter(map(tuple, warc.op11_warc(spark, tiny).collect())) == Counter(duck.execute(warc.ORACLE_SQL).fetchall())
    assert warc.op11_warc(spark, tiny).filter(F.col("payload_bytes").isNull()).count() == 0
