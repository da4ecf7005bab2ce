import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitelens.llm import packing

from .helpers import ODD_TEXTS, odd_documents

TOKENIZER = Tokenizer.from_file(packing.default_tokenizer())
ENCODE = packing.WordEncoder(packing.default_tokenizer())


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["don't", "É", "ñandú ", "\n", " ", "\t", "1²", "<|endoftext|>", " ", "ſ", "é", "日本", "a'll", "!?"]), max_size=20).map("".join))
def test_encoder_equals_the_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(ENCODE(text), dtype="<u4").tolist() == whole(text)


def check(rows, texts, capacity=4096):
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    for i, text in texts.items():
        ids = np.array([*whole(text), 1], dtype="<u4")
        mine = [pieces[i][k] for k in range(len(pieces[i]))]
        assert len(mine) == -(-len(ids) // capacity)
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert sum(r.length for r in mine) == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_query_against_the_tokenizer(spark, small):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = packing.op7_packing(spark, small).collect()
    n, tokens = check(rows, texts)
    assert n <= 1.01 * -(-tokens // 4096) + 1


def test_sequences_hold_their_ids(spark, tiny, monkeypatch):
    """A sequence can be read from the pipeline's last stage, and the query's sums are of the packed ids."""
    monkeypatch.setattr(packing, "MOST_HELD", 3000)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    packed = dict(corpus_pipeline.STAGES)["packing"](spark, docs, tiny)
    rows = packed.collect()
    check(rows, texts)
    for r in rows:
        assert r.ids == [*whole(texts[r.doc_id]), 1][r.start : r.start + r.length]
    shifted = lambda r, kind: (r.doc_id, r.piece, r.length, 0, bytearray((np.array(r.ids) + 1).astype(kind).tobytes()))
    other = spark.createDataFrame([shifted(r, "<u2" if k % 2 else "<u4") for k, r in enumerate(rows)], "doc_id long, piece int, length long, ids_crc32 long, ids binary")
    sums = {(r.doc_id, r.piece): r.ids_crc32 for r in packing.packed_checks(other).collect()}
    assert sums == {(r.doc_id, r.piece): zlib.crc32((np.array(r.ids) + 1).astype("<u4").tobytes()) for r in rows}


def test_rounds_join_shards(spark, small):
    pieces = packing.token_pieces(spark.read.parquet(f"{small}/documents.parquet"), keep_ids=False)
    rows = packing.pack(pieces, shard_pieces=100).collect()
    assert len(rows) == pieces.count()
    least = -(-sum(r.length for r in rows) // 4096)
    assert len({r.sequence_id for r in rows}) <= 1.02 * least + 1


def test_pieces_that_never_combine(spark):
    rows = packing.pack(spark.range(900).selectExpr("id", "3000L as length"), shard_pieces=100).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 900 and {r.offset for r in rows} == {0}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (None, 7)}
    check([r for r in rows if r.doc_id in texts or r.sequence_id], {})
    one = [r for r in rows if r.doc_id in texts]
    for i, t in texts.items():
        ids = [x for r in sorted((r for r in one if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
        assert ids == [*whole(t), 1]
    assert sum(r.piece == 0 for r in rows) == docs.count() == len(ODD_TEXTS) + 2
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert packing.pack_documents(docs, keep_ids=False).count() == len(rows)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 300)
    bins = packing.sum_of_squares(lengths, 20)
    gaps = {}
    for size, at in zip(lengths.tolist(), bins.tolist()):
        def cost(place):
            after = dict(gaps) | {place: gaps.get(place, 20) - size}
            counts = np.bincount([g for g in after.values() if g], minlength=21)
            return int((counts.astype(int) ** 2).sum())

        options = [b for b, g in gaps.items() if g >= size] + [at if at not in gaps else -1]
        assert cost(at) == min(map(cost, options))
        gaps[at] = gaps.get(at, 20) - size


def test_other_tokenizers_are_not_cut_at_spaces(spark, tmp_path):
    """A tokenizer file whose steps differ is used on whole texts, as it stands."""
    import json

    from tokenizers import Tokenizer

    file = json.loads(open(packing.default_tokenizer(), encoding="utf-8").read())
    assert packing.splits_at_spaces(json.dumps(file))
    file["normalizer"] = None
    file["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    other = Tokenizer.from_file(str(path))
    encode = packing.WordEncoder(str(path))
    for text in ("Hello there  World\n and more", "", "a\tb"):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == other.encode(text, add_special_tokens=False).ids
    assert encode("Hello World") != packing.WordEncoder(packing.default_tokenizer())("Hello World")


def test_columns_of_clashing_names(spark):
    pieces = spark.createDataFrame([(3, 7, 8, "x", 1), (None, 7, 8, "x", 4096), (3, 7, 8, "x", 4095)], "doc_id int, sequence_id int, offset int, _full string, length long").withColumn("_shard", F.lit(2))
    rows = packing.pack(pieces).collect()
    assert len(rows) == 3 and all(r._full == "x" and r._shard == 2 for r in rows) and len({r.sequence_id for r in rows}) == 2
