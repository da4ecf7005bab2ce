"""SimHash near-duplicate groups found through segment popcounts.

Fingerprints are 64-bit SimHashes of 3-word shingles. Two fingerprints link when
at most two bits differ. Candidates come from an embedding: the fingerprint is cut
into 3-bit segments (and one of the last bit) and each becomes its number of set bits.
One differing bit moves one coordinate by one, so the Manhattan distance of two
embeddings never exceeds the Hamming distance and pairs at a distance over two can
be left out unseen.

The range join under that distance uses a grid whose cells are the lattice points.
Two points at distance two or less always share a point that is at distance one or
less from both, so each fingerprint is written to its own cell and the at most 44
cells around it, and only cell mates are compared. The exact Hamming test follows.
Segments of three bits keep cells sparse: unrelated fingerprints share one about once in
2^36 times, where four bits would give 2^30, so even 10^10 of them leave a handful to a
cell; smaller segments would only write more cells.

Everything works on distinct fingerprints, so thousands of copies of one text are
one row. A cell with very many distinct fingerprints (a large family of near copies)
isn't paired: its members go to an exact path in which each is written under itself
and its 64 one-bit neighbours. Members meeting at one such word differ in at most
two bits, and all that do meet somewhere, so a star from the smallest member of each
word carries every link's connectivity in a number of rows linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, fits, private, table

SHINGLE = 3
SEED = 42
#: Cells of more distinct fingerprints than this take the exact one-bit-neighbour path.
LARGE_CELL = 48
#: Up to so many ids to drop are broadcast (8 bytes each).
MOST_DROPPED = 500_000


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of one text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        block = hashes[k : k + (1 << 16)]
        total += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        values = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
        yield pd.Series(values.view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """Add the signed 64-bit fingerprint of a text column (null counts as empty), in place of a column of that name."""
    return docs.withColumn(into, _fingerprints(F.col(text)))


#: Bits of a segment, and the first bit of each: 0, 3, ..., 63.
SEGMENT_BITS = 3
_FIRST_BITS = sum(1 << k for k in range(0, 63, SEGMENT_BITS)) - (1 << 63)


def embedding(fp: Column) -> Column:
    """The segments' popcounts, each in the place of its segment, in one long."""
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(_FIRST_BITS)) for k in (1, 2)), fp.bitwiseAND(F.lit(_FIRST_BITS)))


def _cells(point: Column) -> Column:
    """The lattice points at Manhattan distance one or less from a point."""
    around = [point, point.bitwiseXOR(F.lit(-(1 << 63)))]  # the last segment has one bit
    for k in range(0, 63, SEGMENT_BITS):
        at = F.shiftrightunsigned(point, k).bitwiseAND(F.lit(7))
        around += [F.when(at < SEGMENT_BITS, point + F.lit(1 << k)), F.when(at > 0, point - F.lit(1 << k))]
    return F.array_compact(F.array(*around))


def _one_bit(fp: Column) -> Column:
    flips = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(x)) for x in flips])


def links(points: DataFrame, large_cell: int = LARGE_CELL) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all links at two bits or less.

    points: distinct fingerprints in a column ``fp``. For fingerprints of ordinary
    cells every linking pair is returned; those of large cells get a spanning star
    for each group of mutual neighbours instead.
    """
    # A row becomes about 40, so small partitions are not to be joined before.
    spread = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    grid = spread.select("fp", F.explode(_cells(embedding(F.col("fp")))).alias("cell"))
    sizes = grid.groupBy("cell").agg(F.count("*").alias("n"))
    # Spark sizes an exploded table as the table before, and would broadcast one 40 times larger.
    shared = durable(grid.hint("merge").join(sizes.filter("n > 1"), "cell"))
    few = shared.filter(F.col("n") <= large_cell)
    a, b = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    near = a.join(b, (a["cell"] == b["cell"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    near = near.select("a", "b")
    many = shared.filter(F.col("n") > large_cell).select("fp").distinct()
    words = many.select("fp", F.explode(_one_bit(F.col("fp"))).alias("word"))
    first = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    star = words.hint("merge").join(first, "word").filter("a < fp").select("a", F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge list (a, b); root is the component's smallest node.

    Alternates large-star and small-star steps, each a join and an aggregation over the
    edges, until nothing changes; every round is checkpointed.
    """
    edges = durable(edges.select("a", "b"))
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b")
        large = large.filter("a != b").distinct()
        low = large.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("m"))
        near = large.join(low, F.col("b") == F.col("k"))
        small = near.select(F.col("m").alias("a"), "b").unionByName(
            near.filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        )
        edges = durable(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = now


def _rooted(prints: DataFrame, large_cell: int) -> DataFrame:
    """(point, root, component_id) of each distinct fingerprint of (doc_id, fp) rows.

    The labels are written, so that both sides of a later join are plain shuffles and a
    fingerprint that many rows share can be split.
    """
    points = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points.select("fp"), large_cell)).withColumnRenamed("node", "linked")
    # Fingerprints without a link stand for themselves.
    rooted = points.join(roots, F.col("fp") == F.col("linked"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    linked = rooted.filter(F.col("fp") != F.col("root")).select("root").distinct().withColumnRenamed("root", "_root")
    grouped = rooted.join(linked, F.col("root") == F.col("_root"), "left_semi")
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "_root")
    out = rooted.join(named, F.col("root") == F.col("_root"), "left")
    return durable(out.select(F.col("fp").alias("point"), "root", F.when(F.col("_root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")))


def near_duplicate_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", large_cell: int = LARGE_CELL
) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row of a table of texts.

    component_id is the smallest id reachable over links, itself included; root is the
    group's name among fingerprints. Null and empty texts have no words: fingerprint zero,
    linked like any other. Rows that repeat an id each keep a row. A null id never names a
    component; where a whole component has null ids only, its component_id is null. Other
    columns are ignored. An empty table gives an empty result.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = durable(with_fingerprint(base).select("doc_id", "fp"))
    return prints.join(_rooted(prints, large_cell), F.col("fp") == F.col("point")).select("doc_id", "fp", "component_id", "root")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Keep exactly one row of each near-duplicate group, unchanged.

    It is the row with the smallest id, or any id rather than none; of rows that share
    this id, the one with the least signed fingerprint; of those that share both, the one
    with the least text, then the least of all columns as JSON. Null and empty texts form
    one group with whatever else has fingerprint zero. Columns may have any names; an
    empty table stays empty.
    """
    groups = durable(near_duplicate_groups(docs, text, doc_id))
    often = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias("goes"))
    often = durable(often.filter("n > 1 or doc_id is null or goes"))
    # An id of one row goes or stays with it. What goes is listed, not what stays: a list of a proven
    # size is broadcast and no text moves.
    listed, fp, key, row = private(docs, "_listed", "_fp", "_key", "_row")
    leaves = often.filter("doc_id is not null").select(F.col("doc_id").alias(listed))
    leaves = F.broadcast(leaves) if fits(leaves, MOST_DROPPED) else leaves
    single = docs.filter(F.col(doc_id).isNotNull()).join(leaves, F.col(doc_id) == F.col(listed), "left_anti")
    several = durable(often.filter("n > 1 or doc_id is null").select("doc_id"))
    if several.isEmpty():
        return single
    # Rows that share an id, or have none, are told apart by their fingerprints.
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "fp")).alias("first")).select("first.*")
    chosen = first.join(several.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    chosen = durable(chosen.select(F.col("doc_id").alias(key), F.col("fp").alias(row)))
    ids = several.withColumnRenamed("doc_id", listed)
    shared = docs.join(F.broadcast(ids) if fits(ids, MOST_DROPPED) else ids, F.col(doc_id).eqNullSafe(F.col(listed)), "left_semi")
    met = with_fingerprint(shared, text, fp).join(chosen, F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(fp) == F.col(row)), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = met.groupBy(doc_id, fp).agg(F.min_by(whole, F.struct(F.col(text), F.to_json(whole))).alias(row))
    return single.unionByName(kept.select(f"{row}.*"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; see near_duplicate_groups."""
    found = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
