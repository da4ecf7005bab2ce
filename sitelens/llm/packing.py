"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Tokenising runs in Arrow batches. Where the tokenizer file says that it drops white space
and never looks across it, each stretch between spaces is encoded once per worker and then
taken from a bounded cache; texts for any other tokenizer are encoded whole.

Packing keeps N(g), the number of open bins with residual gap g, and puts each piece
where the sum of N(g)^2 becomes smallest: moving a bin from gap g to g - s changes the
sum by 2 (N(g-s) - N(g) + 1). Pieces are dealt into shards of bounded size that pack
independently, longest first; bins that end well short of full give their pieces back,
and a further round of (far fewer) shards packs those, until a single shard is left.
No task or driver ever holds more than one shard.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, private, table

CAPACITY = 4096
END_ID = 1
#: Pieces a packing task handles.
SHARD_PIECES = 10_000
#: A bin filled less than this gives its pieces back for another round.
FULL = 0.995
#: Bytes of ids after which a tokenising task hands on its rows.
MOST_HELD = 4_000_000
CACHE_ENTRIES = 300_000
LONGEST_CACHED = 200

_PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Text of these characters is in composed form, has no white space and can't hold a special
#: token; its letter classes don't depend on the Unicode version. All else goes to the tokenizer.
_PLAIN = re.compile("[!-;=-~\xa1-\u017f]+")


#: The steps of a tokenizer file under which stretches between spaces are encoded one by one.
_NORMAL = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_spaces(file: str) -> bool:
    """Whether a tokenizer (its file's JSON) has just these steps, and so gives the ids of WordEncoder's shorter way."""
    parts = json.loads(file)
    normal = [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in (parts["normalizer"] or {}).get("normalizers", [])]
    cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = len(cuts) == 2 and (cuts[0]["type"], cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ("Split", {"Regex": _SPLIT}, "Removed", True)
    split = split and (cuts[1]["type"], cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == ("ByteLevel", False, False)
    model = parts["model"]
    plain = model["type"] == "BPE" and not model.get("dropout") and model.get("unk_token") is None
    return normal == _NORMAL and split and plain and not any(x["normalized"] or x["lstrip"] or x["rstrip"] for x in parts["added_tokens"])


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _bytes(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


class _Cache(dict):
    """A bounded memo of a function of one string; long strings aren't kept."""

    def __init__(self, function: Callable[[str], bytes]):
        super().__init__()
        self.function = function

    def __missing__(self, key: str) -> bytes:
        value = self.function(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, as the tokenizer file gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            file = source.read()
        self.by_stretch = splits_at_spaces(file)
        self.whole = Tokenizer.from_str(file)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.narrow = self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.stand_in = _byte_characters()
        self.chunks, self.words = _Cache(self._chunk), _Cache(self._word)

    def _word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(self.stand_in.__getitem__, word.encode()))
        return _bytes([t.id for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and _PLAIN.fullmatch(chunk):
            return self.words[chunk.lower()]
        if len(chunk) > LONGEST_CACHED or not _PLAIN.fullmatch(chunk):
            return _bytes(self.whole.encode(chunk, add_special_tokens=False).ids) if chunk else b""
        return b"".join(map(self.words.__getitem__, _PRE_TOKENS.findall(chunk.lower())))

    def __call__(self, text: str) -> bytes:
        if not self.by_stretch:
            return _bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its cache serves all of its tasks."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its token ids and the end id. Only documents longer than the capacity
    are cut. Null text counts as empty: one piece holding the end id alone. Null and
    repeated ids are kept as they are. ids are little-endian unsigned numbers, of 16 bits
    where the tokenizer's vocabulary allows, else of 32; with_id_arrays reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path or default_tokenizer())
        end = np.array([END_ID], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            source, piece, start, length, crc, ids = [], [], [], [], [], []

            def rows() -> pa.RecordBatch:
                columns = {
                    "doc_id": batch.column(0).take(pa.array(source, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                for column in (source, piece, start, length, crc, ids):
                    column.clear()
                return pa.RecordBatch.from_pydict(columns)

            held = 0
            for row, value in enumerate(batch.column(1)):
                data = encode(value.as_py() or "") + end
                kept = np.frombuffer(data, dtype="<u4").astype("<u2").tobytes() if keep_ids and encode.narrow else data
                width = 2 if encode.narrow else 4
                for k in range(0, len(data), step):
                    part = data[k : k + step]
                    source.append(row)
                    piece.append(k // step)
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(kept[k // 4 * width : (k // 4 + capacity) * width])
                        held += len(ids[-1])
                    if held > MOST_HELD:
                        held = 0
                        yield rows()
            yield rows()

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return base.mapInArrow(run, schema)


def _numbers(length: pa.Array, ids: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each row, which take as many bytes each as the length says."""
    for n, data in zip(length.to_pylist(), ids):
        data = data.as_py()
        yield np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")


def with_id_arrays(pieces: DataFrame) -> DataFrame:
    """Rows of token_pieces with their ids as an array of numbers."""
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [x.astype(np.int32) for x in _numbers(part.column("length"), part.column("ids"))]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_pydict({n: ids if n == "ids" else part.column(n) for n in names})

    schema = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length, which are placed in the order given.

    Ties go to the smallest gap that is left, and an open bin is preferred to a new one.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), dtype=np.int64)
    opened, never = 0, np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        before = count[size:]
        # Half the change of the sum, but for a constant; a bin that becomes full leaves the sum.
        change = np.where(before > 0, 2 * (count[: capacity + 1 - size] - before) + 2, never)
        if before[0] > 0:
            change[0] = 1 - 2 * before[0]
        best = int(change.argmin())
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        if change[best] <= fresh:
            gap = size + best
            at = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, at, opened = capacity, opened, opened + 1
        bins[k] = at
        if gap > size:
            count[gap - size] += 1
            stacks[gap - size].append(at)
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Each sequence holds at most ``capacity`` tokens, gapless from offset 0. Rows may have
    any further columns, of any names but for these two, which are replaced; an empty
    table gives an empty result. Rows of equal length are told apart by their order alone,
    and null ids or repeated rows are packed like any other.
    """
    pieces = pieces.drop("sequence_id", "offset")
    full_, shard_ = private(pieces, "_full", "_shard")
    fields = [f.name for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    schema += f", sequence_id long, offset long, `{full_}` boolean"

    def shard(round_: int, last: bool):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            lengths = rows.column("length").to_numpy()
            order = np.argsort(-lengths, kind="stable")
            bins = np.empty(len(lengths), dtype=np.int64)
            bins[order] = sum_of_squares(lengths[order], capacity)
            by_bin = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[by_bin])
            filled = np.bincount(bins, weights=lengths).astype(np.int64)
            offset = np.empty(len(lengths), dtype=np.int64)
            offset[by_bin] = ends - lengths[by_bin] - (np.cumsum(filled) - filled)[bins[by_bin]]
            full = np.ones(len(bins), dtype=bool) if last else filled[bins] >= FULL * capacity
            found = bins + (round_ << 56) + (key[0].as_py() << 24)
            out = rows.select(fields)
            for name, values in (("sequence_id", found), ("offset", offset), (full_, full)):
                out = out.append_column(name, pa.array(values))
            return out

        return run

    done, left, round_, before = None, durable(pieces.select(*fields)), 0, None
    while True:
        count = left.count()
        shards = max(1, -(-count // shard_pieces))
        # Pieces that no shard can combine, such as many of 60 % of the capacity, won't be by another round.
        last = shards == 1 or before is not None and 2 * count > before
        dealt = left.withColumn(shard_, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
        packed = durable(dealt.groupBy(shard_).applyInArrow(shard(round_, last), schema))
        ready = packed.filter(F.col(full_)).drop(full_)
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        left, round_, before = durable(packed.filter(~F.col(full_)).select(*fields)), round_ + 1, count


def placed_pieces(docs: DataFrame, **options) -> DataFrame:
    """Rows of token_pieces, ids as bytes, with their sequence_id and offset.

    The ids stay where they were written while the lengths are packed, and meet their
    places in one join at the end, for which they aren't sorted.
    """
    pieces = durable(token_pieces(docs, **options).withColumn("_row", F.monotonically_increasing_id()))
    placed = pack(pieces.select(F.col("_row").alias("_placed"), "length"), options.get("capacity", CAPACITY)).drop("length")
    return pieces.join(placed.hint("shuffle_hash"), F.col("_row") == F.col("_placed")).drop("_row", "_placed")


def pack_documents(docs: DataFrame, keep_ids: bool = True, **options) -> DataFrame:
    """Tokenise and pack a table of texts; see token_pieces and pack. ids are arrays of numbers.

    Null and empty texts are one piece holding the end id; other columns of docs are left out.
    """
    if not keep_ids:
        return pack(token_pieces(docs, keep_ids=False, **options), options.get("capacity", CAPACITY))
    return with_id_arrays(placed_pieces(docs, **options))


def packed_checks(packed: DataFrame) -> DataFrame:
    """Rows of placed_pieces without their ids, ids_crc32 taken anew from these."""
    names = [c for c in packed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in _numbers(batch.column("length"), batch.column("ids"))]
            kept = {n: batch.column(n) for n in names} | {"ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(kept)

    return packed.mapInArrow(run, packed.select(*names).schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every piece of every document; see placed_pieces."""
    return packed_checks(placed_pieces(table(spark, sf_dir, "documents")))
