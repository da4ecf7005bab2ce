"""Shared helpers of the training-data operators: tables, durable cuts, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.durable import durable

__all__ = ["ascii_lower", "byte_words", "cased_words", "durable", "fits", "held_out", "hash_sample", "private", "table", "word_lower"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Everything that ends a word once A-Z is lower-cased, and the same with A-Z kept.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD_CASED = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: For bytes.translate after bytes.lower(): separators become a space.
WORD_BYTES = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def word_lower(word: Column) -> Column:
    """ascii_lower of a word; a word of ASCII alone takes the quicker built-in way to the same result."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def cased_words(text: Column) -> Column:
    """Words of a text (null: none) as they are written; ``word_lower`` each for the words proper.

    The separators are the same before and after lower-casing, so splitting
    first saves mapping every character of every text.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_WORD_CASED), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words, lower-cased, as UTF-8, for code that runs inside Python tasks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(WORD_BYTES).split()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from. A null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fits(df: DataFrame, most_rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than it must to know."""
    return df.limit(most_rows + 1).count() <= most_rows


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names for passing use that no column of the table has, whatever the letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Parts that a value's rows are ranked in.
SAMPLE_PARTS = 16


def hash_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most so many rows of each value of ``by``; all of a value that has no more.

    They are those whose ``key`` hashes lowest, an equal share from each of SAMPLE_PARTS
    parts of its rows, ties by key. Rows that can't be among them by a wide margin go before
    anything is sorted, so that the sort handles about twice the sample however many rows
    there are, and no task more than a part of a value. The hash is spread evenly over
    distinct keys; repeated keys share it and are told apart by the sort alone.
    """
    h, total, value, rank, part = private(rows, "_hash", "_total", "_value", "_rank", "_part")
    counts = rows.groupBy(F.col(by).alias(value)).agg(F.count("*").alias(total))
    near = rows.withColumn(h, F.xxhash64(key)).join(counts, F.col(by).eqNullSafe(F.col(value)))
    # Hashes run evenly from -2^63 to 2^63; a share of 1 or more keeps them all.
    near = near.filter(F.col(h).cast("double") <= (F.lit(2.0 * most) / F.col(total) - 0.5) * 2.0**64)
    near = near.withColumn(part, F.pmod(F.col(h), F.lit(SAMPLE_PARTS)))
    first = F.row_number().over(Window.partitionBy(by, part).orderBy(h, key))
    near = near.withColumn(rank, first).filter((F.col(total) <= most) | (F.col(rank) <= most // SAMPLE_PARTS))
    return near.select(*rows.columns)
