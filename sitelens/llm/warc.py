"""WARC archives: a writer with revisit records and a sequential reader.

Every record is one gzip member. The reader inflates a file member by member in bounded
steps, takes the record apart as the bytes come (header lines, then a block of as many
bytes as its content length says, of which the payload follows the HTTP header) and holds
the digests of what it read against the declared ones. A member that can't be read is
reported and the next one is looked for.

Archives are written by Spark's own sink, so that they lie wherever Spark can write and a
retried task leaves no second copy: each row is a run of members, and rows are separated
by a member without content, which gzip allows anywhere.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.durable import shared_folder

from .common import durable, fits, private, table

#: Payloads of fewer bytes are never replaced by a revisit record.
LEAST_REVISITED = 1_000
#: Up to so many payloads that several records share, their table is broadcast.
MOST_BROADCAST = 100_000
#: Compressed bytes of a row of members, and rows of an archive: archives have about 32 MB.
RUN_BYTES, RUNS_PER_ARCHIVE = 1 << 20, 32
#: Inflated and compressed bytes that the reader takes at once, and bytes of a batch of read records.
STEP, BATCH_BYTES = 1 << 16, 1 << 23
#: A header of more bytes is damage.
LONGEST_HEADER = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_SPACE = uuid.UUID("5c8d5f0e-2a53-5a7e-9d8a-7a3f6f0b1c11")
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003" + "0300" + "00000000" + "00000000")

RECORD_SCHEMA = (
    "archive string, offset long, record_id string, record_type string, target_uri string, page_id string, "
    "payload_bytes long, payload_digest string, refers_to string, intact boolean, error string, payload binary"
)
_RECORD_ARROW = pa.schema(
    [(n.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[n.split()[1]]) for n in RECORD_SCHEMA.split(", ")]
)


def record_id(page_id: str | None, digest: str, kind: str = "response") -> str:
    """The name of a record, from what it holds."""
    return uuid.uuid5(ID_SPACE, f"{kind} {page_id} {digest}").urn


def encode_record(page_id: str | None, url: str | None, payload: bytes, digest: str, original: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member: a response, or a revisit of the page ``original``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if original is None else "revisit"
    block = http + payload if original is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(page_id, digest, kind)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if page_id is not None:
        lines.append("X-Page-ID: " + quote(page_id, safe=""))
    if original is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(original, digest)}>"]
    lines += [f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"WARC-Payload-Digest: sha1:{digest}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of joined members, of ``most`` bytes or a single larger member."""
    held, size = [], 0
    pack = lambda: pa.RecordBatch.from_pydict({"run": pa.array([b"".join(held)], pa.binary())})
    for batch in batches:
        names = batch.schema.names
        for k in range(batch.num_rows):
            row = {n: batch.column(i)[k].as_py() for i, n in enumerate(names)}
            member = encode_record(row["page_id"], row["url"], row["payload"], row["digest"], row["original"])
            if held and size + len(member) > most:
                yield pack()
                held, size = [], 0
            held.append(member)
            size += len(member)
    if held:
        yield pack()


def _payload_keys(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    # A second hash and the length tell payloads apart whose SHA-1 someone has made equal.
    return rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"), F.xxhash64("payload").alias("other"))


def write_archives(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", run_bytes: int = RUN_BYTES, runs: int = RUNS_PER_ARCHIVE
) -> None:
    """Write one record for every row of pages to archives below ``folder``.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of
    LEAST_REVISITED bytes or more, that with the largest page_id is a response and the
    others are revisits of it; rows that share that id and payload are all responses, and
    where no row has an id all are. Null ids and urls are left out of the record's header.
    Other columns of pages are left out. Only digests and ids are shuffled to find the
    largest ids; payloads move when those can't be broadcast.
    """
    rows = _payload_keys(pages, page_id, url, html)
    shared = rows.filter(F.col("bytes") >= LEAST_REVISITED).groupBy("digest", "bytes", "other")
    shared = shared.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null")
    shared = durable(shared.select(*(F.col(c).alias(f"of_{c}") for c in ("digest", "bytes", "other")), "original"))
    same = (F.col("digest") == F.col("of_digest")) & (F.col("bytes") == F.col("of_bytes")) & (F.col("other") == F.col("of_other"))
    rows = rows.join(F.broadcast(shared) if fits(shared, MOST_BROADCAST) else shared, same, "left")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original").cast("string"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", original.alias("original"))
    packed = rows.mapInArrow(lambda batches: _runs(batches, run_bytes), "run binary").select(F.col("run").cast("string").alias("value"))
    sink = packed.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    sink.option("maxRecordsPerFile", runs).option("compression", "none").text(folder)


class Damaged(ValueError):
    """A member that is no right record."""


class _Record:
    """Takes the inflated bytes of one member as they come."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.fields, self.left = keep, b"", None, 0
        self.http, self.tail, self.parts, self.size = b"", b"", [], 0
        self.block, self.payload, self.seen = hashlib.sha1(), hashlib.sha1(), 0

    def feed(self, data: bytes) -> None:
        self.seen += len(data)
        if self.fields is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                if len(self.head) > LONGEST_HEADER:
                    raise Damaged("header without an end")
                return
            self.fields, data, self.head = self._fields(self.head[:end]), self.head[end + 4 :], b""
            length = self.fields.get("content-length", "")
            if not length.isdecimal():
                raise Damaged("no content length")
            self.left = int(length)
            self.framed = self.fields.get("content-type", "").lower().startswith("application/http")
        body, rest = data[: self.left], data[self.left :]
        self.left -= len(body)
        self.block.update(body)
        if body and self.framed:
            self.http += body
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                body = b""
                if len(self.http) > LONGEST_HEADER:
                    raise Damaged("HTTP header without an end")
            else:
                self.answer, body, self.http, self.framed = self._fields(self.http[:end]), self.http[end + 4 :], b"", False
        if body:
            self.payload.update(body)
            self.size += len(body)
            if self.keep:
                self.parts.append(body)
        self.tail += rest
        if len(self.tail) > 4:
            raise Damaged("bytes after the record")

    @staticmethod
    def _fields(head: bytes) -> dict[str, str]:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith(("WARC/", "HTTP/")):
            raise Damaged("no record begins here")
        found: dict[str, str] = {"": first}
        for line in lines:
            name, mark, value = line.partition(":")
            if not mark:
                raise Damaged("header line without a colon")
            found.setdefault(name.strip().lower(), value.strip())
        return found

    answer: dict[str, str] = {}

    def row(self) -> dict:
        if self.fields is None or self.left or self.tail != b"\r\n\r\n":
            raise Damaged("record is cut short")
        get = self.fields.get
        declared, digest = get("warc-payload-digest", "").removeprefix("sha1:"), self.payload.hexdigest()
        if get("warc-block-digest", "").removeprefix("sha1:") not in ("", self.block.hexdigest()):
            raise Damaged("block digest differs")
        size = self.size
        if get("warc-type") == "revisit":  # the payload lies in the record that it refers to
            digest, length = declared, self.answer.get("content-length", "")
            size = int(length) if length.isdecimal() else None
        elif declared not in ("", digest):
            raise Damaged("payload digest differs")
        page = get("x-page-id")
        return {
            "record_id": get("warc-record-id", "").strip("<>"), "record_type": get("warc-type"), "target_uri": get("warc-target-uri"),
            "page_id": None if page is None else unquote(page), "payload_bytes": size, "payload_digest": digest,
            "refers_to": get("warc-refers-to", "").strip("<>") or None, "intact": True, "error": None, "payload": b"".join(self.parts) if self.keep else None,
        }


def read_members(data: memoryview, keep: bool = True) -> Iterator[dict]:
    """The records of an archive in order, each with the offset of its member."""
    at, lost = 0, False
    while at < len(data):
        start, record, stream = at, _Record(keep), zlib.decompressobj(31)
        try:
            while not stream.eof and at < len(data):
                piece = bytes(data[at : at + STEP])
                at += len(piece)
                while piece and not stream.eof:
                    record.feed(stream.decompress(piece, STEP))
                    piece = stream.unconsumed_tail
            if not stream.eof:
                raise Damaged("archive is cut short")
            at -= len(stream.unused_data)
            if record.seen:
                yield record.row() | {"offset": start}
            lost = False
        except (Damaged, zlib.error) as error:
            if not lost:
                yield {"offset": start, "intact": False, "error": str(error)}
            lost, at = True, _next_member(data, start + 1)


def _next_member(data: memoryview, at: int) -> int:
    """Where the next gzip header may be, or the end."""
    while at < len(data):
        found = bytes(data[at : at + STEP + 2]).find(b"\x1f\x8b\x08")
        if found >= 0:
            return at + found
        at += STEP
    return len(data)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row of RECORD_SCHEMA for every record of the archives below ``folder``.

    A record whose framing or digests are wrong has intact false and its error, and reading
    goes on at the next member; a run of bytes that holds no record is one such row. A
    revisit's payload_bytes and payload_digest are the declared ones of the payload that
    it refers to. Without ``payloads`` the payload is null. A folder without archives gives
    an empty table. Files are read whole by a task, so they should be of bounded size.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in read_members(memoryview(content.as_buffer()), payloads):
                    held.append({"archive": path.as_py()} | row)
                    size += len(row.get("payload") or b"") + 500
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(read, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Rows of read_archives with ``original``, the page_id of the response that a revisit refers to.

    It is null for other records, and where no response of that name has the revisit's
    payload digest. Records that were written twice count once as what is referred to.
    """
    name, digest, page = private(records, "_named", "_digest", "_page")
    answers = records.filter("record_type = 'response' and intact").select(F.col("record_id").alias(name), F.col("payload_digest").alias(digest), F.col("page_id").alias(page))
    revisits = records.filter("record_type = 'revisit'")
    meets = (F.col("refers_to") == F.col(name)) & (F.col("payload_digest") == F.col(digest))
    revisits = revisits.join(answers.dropDuplicates([name]), meets, "left").select(*records.columns, F.col(page).alias("original"))
    others = records.filter("record_type is distinct from 'revisit'").withColumn("original", F.lit(None).cast("string"))
    return others.unionByName(revisits)


def _whole(value: Column) -> Column:
    """The value, for a record that was read whole; the operator's own archives have no others."""
    return F.when(F.col("intact"), value).otherwise(F.raise_error(F.concat(F.lit("damaged record: "), F.col("error"))))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every page, as the archives that were written hold them."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    records = durable(read_archives(spark, folder, payloads=False).drop("payload"))
    kind = pages.schema["page_id"].dataType
    return resolved(records).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        _whole(F.col("record_type")).alias("record_type"),
        F.col("original").cast(kind).alias("refers_to"),
    )


#: The contract by grouping whole payloads.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
 k AS (SELECT *, CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS keeper FROM p),
 r AS (SELECT *, CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM k)
SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
 CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
