"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton over magic bytes proposes places and kinds; a validator per
format then walks the structure (chunk lengths, checksums, end markers) and gives the
medium's exact length, or refuses. What begins at byte 0 corrects the declared type;
valid media elsewhere are carved as embedded.
"""

from __future__ import annotations

import math
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import private, table

#: Payloads are padded to a positive multiple of this.
FRAME = 576
PAD = b"\xff"
#: Parameters of the stored audio: mono, 8 bits a sample.
SAMPLE_RATE = 8000
WAV_HEADER = 44


def _png(b: bytes, at: int) -> int:
    """Chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or first != (kind == b"IHDR") or first and size != 13:
            return 0
        if struct.unpack_from(">I", b, pos + 8 + size)[0] != zlib.crc32(b[pos + 4 : pos + 8 + size]):
            return 0
        pos, first = pos + 12 + size, False
        if kind == b"IEND":
            return pos - at
    return 0


def _jpeg(b: bytes, at: int) -> int:
    """Marker segments up to the scan, then entropy-coded data to the end marker."""
    pos, scan = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return 0
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at if scan else 0
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if not 0xC0 <= kind <= 0xFE or size < 2:
            return 0
        pos += 2 + size
        if kind == 0xDA:
            scan = True
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0 or pos + 1 >= len(b):
                return 0
            if b[pos + 1] == 0xD9:
                return pos + 2 - at
    return 0


def _gif(b: bytes, at: int) -> int:
    """Screen, blocks with their sub-block chains, trailer."""
    if at + 13 > len(b):
        return 0
    flags, pos, image = b[at + 10], at + 13, False
    pos += 3 << (flags & 7) + 1 if flags & 0x80 else 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at if image else 0
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            flags, pos, image = b[pos + 9], pos + 10, True
            pos += (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return 0


def _riff(b: bytes, at: int) -> int:
    """Sub-chunks that fill the declared size exactly, with the ones the form needs."""
    if at + 12 > len(b):
        return 0
    size, form = struct.unpack_from("<I4s", b, at + 4)
    end, pos, kinds = at + 8 + size, at + 12, set()
    if end > len(b):
        return 0
    while pos + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, pos)
        kinds.add(kind)
        pos += 8 + n + (n & 1)
    need = {b"WAVE": {b"fmt ", b"data"}}.get(form)
    right = need <= kinds if need else form == b"WEBP" and bool(kinds & {b"VP8 ", b"VP8L", b"VP8X"})
    return end - at + (size & 1 if end < len(b) else 0) if right and pos - end in (0, 1) else 0


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    right = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return size if right and 14 + header <= start <= size <= len(b) - at else 0


def _gzip(b: bytes, at: int) -> int:
    """A member that inflates to its end and matches its trailer."""
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    try:
        inflate = zlib.decompressobj(31)
        pos = at
        while not inflate.eof:
            block = b[pos : pos + 65536]
            if not block:
                return 0
            pos += len(block)
            while block and not inflate.eof:
                inflate.decompress(block, 1 << 20)
                block = inflate.unconsumed_tail
        return pos - len(inflate.unused_data) - at
    except zlib.error:
        return 0


class _Marks:
    """Where the closing marks of ZIP and PDF stand in a value, found once however many begin there."""

    def __init__(self, data: bytes):
        self.data = data
        self.found: dict[bytes, list[int]] = {}
        self.archives: dict[int, int] | None = None

    def at(self, mark: bytes) -> list[int]:
        if mark not in self.found:
            places, k = [], self.data.find(mark)
            while k >= 0:
                places.append(k)
                k = self.data.find(mark, k + 1)
            self.found[mark] = places
        return self.found[mark]


def _zip(b: bytes, at: int, marks: _Marks) -> int:
    """A local header whose archive ends in a directory that counts back to it."""
    if marks.archives is None:
        marks.archives = {}
        for end in marks.at(b"PK\x05\x06"):
            if end + 22 <= len(b):
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                begin = end - size - start
                if begin >= 0 and b[begin + start : begin + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                    marks.archives.setdefault(begin, end + 22 + note)
    return marks.archives.get(at, at) - at


def _pdf(b: bytes, at: int, marks: _Marks) -> int:
    """From the head to the last end mark before the next head, with a cross-reference before it."""
    heads, ends, tables = (marks.at(m) for m in (b"%PDF-", b"%%EOF", b"startxref"))
    k = bisect_left(heads, at + 1)
    last = bisect_left(ends, heads[k] - 4 if k < len(heads) else len(b)) - 1
    if last < 0 or ends[last] < at:
        return 0
    k = bisect_left(tables, at)
    return ends[last] + 5 - at if k < len(tables) and tables[k] + 9 <= ends[last] else 0


#: The formats' magic bytes and media types.
FORMATS: list[tuple[bytes, str, Callable[..., int]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"RIFF", "riff", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"\x1f\x8b", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
]
_RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp"}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


def sniff(data: bytes | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid media in a value, left to right.

    The medium at byte 0 comes first. What lies inside a carved medium is not reported
    again, but the inside of the one at byte 0 is searched, since containers embed media.
    """
    found, free, marks = [], 0, _Marks(data or b"")
    for last, k in automaton.iter((data or b"").decode("latin-1")):
        magic, kind, validate = FORMATS[k]
        at = last + 1 - len(magic)
        if at < free or not (size := validate(data, at, marks) if validate in (_zip, _pdf) else validate(data, at)):
            continue
        found.append((at, size, _RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind))
        free = at + size if at else 0
    return found


_SPANS = T.ArrayType(
    T.StructType().add("offset", T.IntegerType()).add("length", T.IntegerType()).add("type", T.StringType())
)


@F.pandas_udf(_SPANS)
def _media(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    automaton = _automaton()
    for values in parts:
        yield pd.Series([[dict(zip(("offset", "length", "type"), x)) for x in sniff(v, automaton)] for v in values])


def with_media(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """Add media_type (corrected), media_length, type_corrected and embedded.

    media_type is what the bytes prove to be from byte 0, else the declared type;
    media_length is that medium's proven length, else null; embedded is an array of
    (offset, length, type) of further media. Null, empty and unknown bytes keep their
    declared type and have nothing embedded; type_corrected is then false. All rows and
    other columns stay; columns that have these names already are replaced.
    """
    (seen,) = private(df, "_media")
    all_ = df.withColumn(seen, _media(F.col(media)))
    head = F.get(F.filter(seen, lambda m: m["offset"] == 0), 0)
    known = head["type"].isNotNull()
    return (
        all_.withColumn("media_type", F.when(known, head["type"]).otherwise(F.col(declared)))
        .withColumn("media_length", head["length"])
        .withColumn("type_corrected", known & ~head["type"].eqNullSafe(F.col(declared)))
        .withColumn("embedded", F.coalesce(F.filter(seen, lambda m: m["offset"] > 0), F.array().cast(_SPANS)))
        .drop(seen)
    )


def carve(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per embedded medium of a with_media result, with its bytes in ``carved``."""
    (one,) = private(df, "_one")
    each = df.withColumn(one, F.explode("embedded"))
    bytes_ = F.substring(F.col(media), F.col(f"{one}.offset") + 1, F.col(f"{one}.length"))
    return each.withColumn("carved", bytes_).withColumn("carved_type", F.col(f"{one}.type")).drop(one)


def _little_endian(n: Column, width: int = 4) -> Column:
    big = F.lpad(F.hex(n), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(big, 2 * k + 1, 2) for k in reversed(range(width))]))


def padded(data: Column, frame: int = FRAME) -> Column:
    """Bytes 255 appended up to a positive multiple of the frame; null counts as empty."""
    data = F.coalesce(data, F.lit(b""))
    size = F.octet_length(data)
    full = F.greatest(F.ceil(size / frame), F.lit(1)) * frame
    return F.concat(data, F.unhex(F.repeat(F.lit(PAD.hex()), (full - size).cast("int"))))


def as_wav(samples: Column) -> Column:
    """Bytes as the unsigned 8-bit samples of a mono WAV file, unchanged and in order.

    The frame is even, so padded payloads need no pad byte of the format.
    """
    size = F.octet_length(samples)
    fixed = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data")
    return F.concat(
        F.lit(b"RIFF"), _little_endian(size + (WAV_HEADER - 8)), F.lit(b"WAVE"), F.lit(fixed), _little_endian(size), samples
    )


@F.pandas_udf(T.StringType())
def wav_features(media: pd.Series) -> pd.Series:
    """Rate, sample count, mean, deviation, zero crossings and entropy of 8-bit WAV bytes."""

    def features(b: bytes | None) -> str | None:
        if b is None or len(b) <= WAV_HEADER:
            return None
        rate = struct.unpack_from("<I", b, 24)[0]
        x = np.frombuffer(b, dtype=np.uint8, offset=WAV_HEADER)
        count = np.bincount(x, minlength=256)
        n, values = len(x), np.arange(256)
        mean = float(count @ values) / n
        deviation = math.sqrt(max(0.0, float(count @ values**2) / n - mean * mean))
        above = x >= 128
        crossings = int(np.count_nonzero(above[1:] != above[:-1]))
        p = count[count > 0] / n
        entropy = float(-(p * np.log2(p)).sum())
        return f"rate={rate};samples={n};mean={mean:.4f};deviation={deviation:.4f};crossings={crossings};entropy={entropy:.4f}"

    return media.map(features)


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add media (the text's padded bytes as WAV), n_bytes and declared_type.

    Nothing is declared but octets, so that the type has to come from the bytes.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.withColumn("n_bytes", F.octet_length(data).cast("long")).withColumn("media", as_wav(padded(data))).withColumn(
        "declared_type", F.lit("application/octet-stream")
    )


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; see store_texts, with_media and wav_features."""
    stored = store_texts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "media", "declared_type")
    seen = with_media(stored).withColumn("feature", wav_features(F.col("media")))
    #: The payload is what the validator proved to be the WAV at byte 0, less its header.
    payload = F.substring(F.col("media"), F.lit(WAV_HEADER + 1), F.col("media_length") - WAV_HEADER)
    size = F.octet_length(payload)
    return seen.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, size - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", "media_type", "feature", F.concat(F.lit("embedded="), F.size("embedded"))).alias("feature"),
    )
