import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

from sitelens.llm import media

from .helpers import ODD_TEXTS, odd_documents


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2D\1\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\x12\xff\0\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
KINDS = {"image/png": png(), "application/zip": archive(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/gzip": gzip.compress(b"x" * 500, mtime=0)}


def test_formats_are_recognised_measured_and_refused():
    automaton = media._automaton()
    for kind, data in KINDS.items():
        assert media.sniff(data + b" trailing", automaton)[0] == (0, len(data), kind), kind
        assert media.sniff(b"lead " + data + b" tail", automaton) == [(5, len(data), kind)], kind
        assert not media.sniff(data[:-3], automaton), kind
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken), automaton) == [] == media.sniff(None, automaton) == media.sniff(b"", automaton)


def test_types_are_corrected_and_media_carved(spark):
    rows = [(k, d, "text/plain", i) for i, (k, d) in enumerate(KINDS.items())]
    rows += [("none", None, None, 0), ("text", b"BM GIF89a RIFF", "text/plain", 0), ("both", b"ab" + png() + b"cd" + GIF, "text/plain", 0), ("right", png(), "image/png", 0)]
    seen = media.with_media(spark.createDataFrame(rows, "name string, media binary, declared_type string, offset int"))
    got = {r["name"]: r for r in seen.collect()}
    for kind, data in KINDS.items():
        assert (got[kind].media_type, got[kind].media_length, got[kind].type_corrected) == (kind, len(data), True)
    assert (got["none"].media_type, got["none"].type_corrected, got["none"].embedded) == (None, False, [])
    assert (got["text"].media_type, got["text"].type_corrected, got["text"].embedded) == ("text/plain", False, [])
    assert not got["right"].type_corrected
    carved = {(r["name"], r.carved_type): bytes(r.carved) for r in media.carve(seen.filter("name = 'both'")).collect()}
    assert carved == {("both", "image/png"): png(), ("both", "image/gif"): GIF}


def test_query_round_trip(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    stored = media.store_texts(odd_documents(spark)).collect()
    want = {}
    for r in stored:
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == payload
        want[hashlib.sha256(payload).hexdigest()] = (len(raw), len(payload), zlib.crc32(payload[-32:]), len(r.media), hashlib.sha256(r.media).hexdigest())
    rows = media.op1_media(spark, str(tmp_path)).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    for r in rows:
        assert want[r.payload_sha256] == (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes, r.media_sha256)
        assert r.feature.startswith("audio/wav;")
    assert media.with_media(media.store_texts(odd_documents(spark).limit(0))).count() == 0


def test_hostile_values_take_linear_time():
    import time

    automaton, began = media._automaton(), time.time()
    for value in (b"PK\x03\x04" * 200_000, (b"PK\x03\x04" + b"PK\x05\x06" + b"x" * 18) * 30_000, b"%PDF-" * 200_000 + b"%%EOF", b"%PDF-1 %%EOF " * 80_000):
        assert media.sniff(value, automaton) == []
    assert time.time() - began < 20
    pdf = b"%PDF-1.7 stuff startxref 12 %%EOF"
    assert media.sniff(b"ab" + pdf + b"\n" + pdf, automaton) == [(2, len(pdf), "application/pdf"), (3 + len(pdf), len(pdf), "application/pdf")]


def test_clashing_names(spark):
    df = spark.createDataFrame([(bytearray(b"GIF89a"), "image/png", 1, "x")], "media binary, declared_type string, _media int, media_type string")
    (row,) = media.with_media(df).collect()
    assert row._media == 1 and row.media_type == "image/png" and not row.type_corrected
