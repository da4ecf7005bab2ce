"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item is cut into windows of 13 consecutive words. A document can hold a
window only if it holds every word of it, so the join needs one word of each window:
the prefix, which is the rarest of the window's words by the number of documents that
hold it. Documents emit the positions of prefix words alone; a join on the word gives
the place where the window would have to start, bounds discard places that leave the
document, and the words there are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cased_words, durable, fits, private, table, word_lower

WINDOW = 13
#: Words of each window whose document frequency is counted; the rarest within the benchmark go first.
RIVALS = 3
#: Up to so many prefix words documents are filtered with a literal set; beyond, the
#: positions of all words are matched by a shuffle, and only texts with a match move.
MOST_LITERALS = 20_000
#: Up to so many windows of so many bytes in all are broadcast; beyond, places meet them in a shuffle.
MOST_WINDOWS, MOST_WINDOW_BYTES = 200_000, 32 << 20
#: Up to so many contaminated texts the drop list is broadcast.
MOST_DROPPED = 200_000


def item_windows(items: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(window, item): each item's windows as space-joined words, distinct."""
    words = F.transform(cased_words(F.col(text)), word_lower)
    cut = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words.alias("words")).filter("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = cut.select("item", "words", F.explode(starts).alias("at"))
    return cut.select(F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.lit(window))).alias("window"), "item").distinct()


def _places(words: Column, vocabulary: list[str]) -> Column:
    """Positions (from 0) of the words that are of a vocabulary of lower-cased words."""
    wanted = sorted(set(vocabulary))
    return F.array_compact(F.transform(words, lambda w, k: F.when(word_lower(w).isin(wanted), k)))


def _vocabulary(words: DataFrame) -> list[str] | None:
    found = words.select("word").distinct()
    return [r[0] for r in found.collect()] if fits(found, MOST_LITERALS) else None


def _few(prefix: DataFrame) -> bool:
    """Whether the windows may be broadcast: many of them can share few prefix words."""
    n, size = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    return n <= MOST_WINDOWS and size <= MOST_WINDOW_BYTES


def prefixes(windows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(window, word, skip, n): the rarest word of each window, its place in it, the window's words."""
    words = windows.select("window").distinct().select("window", F.split("window", " ").alias("words"))
    each = words.select("window", F.size("words").alias("n"), F.explode(F.array_distinct("words")).alias("word"), "words")
    each = each.withColumn("skip", F.array_position("words", F.col("word")).cast("int") - 1).drop("words")
    counts = each.groupBy("word").agg(F.count("*").alias("within"))
    rank = F.row_number().over(Window.partitionBy("window").orderBy("within", "word"))
    rivals = durable(each.join(counts, "word").withColumn("rank", rank).filter(F.col("rank") <= RIVALS).drop("rank"))
    vocabulary = _vocabulary(rivals)
    held = docs.select(cased_words(F.col(text)).alias("words"))
    if vocabulary is None:
        held = held.select(F.explode(F.array_distinct(F.transform("words", word_lower))).alias("word"))
        held = held.join(rivals.select("word").distinct(), "word", "left_semi")
    else:
        lowered = F.transform(_places(F.col("words"), vocabulary), lambda k: word_lower(F.get("words", k)))
        held = held.select(F.explode(F.array_distinct(lowered)).alias("word"))
    frequency = held.groupBy("word").agg(F.count("*").alias("documents"))
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.coalesce("documents", F.lit(0)), "within", "word"))
    best = rivals.join(frequency, "word", "left").withColumn("rank", rank).filter("rank = 1")
    return durable(best.select("window", "word", "skip", "n"))


def text_key(text: Column) -> Column:
    """Results depend on the text alone, so rows are told apart by their text, not their id."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def occurrences(docs: DataFrame, prefix: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, n, window), distinct: where windows occur in the texts."""
    vocabulary = _vocabulary(prefix)
    base = docs.select(text_key(F.col(text)).alias("key"), cased_words(F.col(text)).alias("words"))
    first = lambda k: F.greatest(k - (window - 1), F.lit(0))
    # Each place takes along the words a window through it can cover, so that no row carries a whole text.
    around = lambda k: F.transform(F.slice("words", first(k) + 1, F.lit(2 * window - 1)), word_lower)
    place = lambda k: F.struct(k.alias("at"), first(k).alias("first"), around(k).alias("around"))
    if vocabulary is None:
        # Narrow rows of every word meet the prefix words first; the words around are read where one did.
        every = base.select("key", F.posexplode(F.transform("words", word_lower)).alias("at", "word"))
        met = every.join(prefix.select("word").distinct(), "word", "left_semi").select("key", "at").distinct()
        places = durable(met.groupBy(F.col("key").alias("met")).agg(F.collect_list("at").alias("places")))
        once = docs.filter(F.col(text) != "").groupBy(F.col(text)).count()  # a text that many rows share is read once
        base = once.select(text_key(F.col(text)).alias("key"), cased_words(F.col(text)).alias("words"))
        base = base.join(places, F.col("key") == F.col("met"))
    else:
        base = base.withColumn("places", _places(F.col("words"), vocabulary))
    near = base.select("key", F.size("words").alias("n_words"), F.explode(F.transform("places", place)).alias("place"))
    near = near.select("key", "n_words", "place.*").withColumn("word", F.get("around", F.col("at") - F.col("first")))
    found = near.join(F.broadcast(prefix) if vocabulary is not None and _few(prefix) else prefix, "word")
    found = found.withColumn("start", F.col("at") - F.col("skip"))
    found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    there = F.concat_ws(" ", F.slice("around", F.col("start") - F.col("first") + 1, F.col("n")))
    return found.filter(there == F.col("window")).select("key", "start", "n", "window").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """(key, n_hit, items) for each text with an occurring window; key is text_key(text).

    n_hit counts words inside any occurrence; items is the sorted array of item ids. Items
    without words have no window, an item without an id goes by the empty string, repeated
    ids are one. Null and empty texts never hit. Empty tables give an empty result.
    """
    windows = durable(item_windows(items, item_text, item_id))
    seen = durable(occurrences(docs, prefixes(windows, docs, text), text))
    order = Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    covered = F.coalesce(F.max(end).over(order), F.lit(0))
    hits = seen.withColumn("fresh", F.greatest(end - F.greatest("start", covered), F.lit(0)))
    hits = hits.groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    named = seen.select("key", "window").distinct().join(windows, "window")
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return hits.join(named, "key")


def with_contamination(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, items and contaminated for every row of docs, repeated rows included.

    Null and empty texts have no words, no hits and aren't contaminated; without items
    nothing is. Other columns are left out.
    """
    # A written table, so that a join side is a plain shuffle and a text that many rows share can be split.
    found = durable(contamination(docs, items, text))
    rows = docs.select("doc_id", text_key(F.col(text)).alias("key"), F.size(cased_words(F.col(text))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(found, "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, but for those of which 5 % or more is benchmark text.

    Rows with null or empty texts stay, as do all rows where there are no items; rows of
    equal texts stay or go together, whatever their ids. Columns may have any names.
    """
    found = contamination(docs, items, text)
    n_words = docs.select(text_key(F.col(text)).alias("key"), F.size(cased_words(F.col(text))).alias("n_words"))
    small = durable(found.select("key", "n_hit"))
    few = fits(small, MOST_DROPPED)
    judged = n_words.join(F.broadcast(small) if few else small, "key")
    mine, gone = private(docs, "_text_key", "_drop")
    drop = durable(judged.filter("20 * n_hit >= n_words").select(F.col("key").alias(gone)).distinct())
    keyed = docs.withColumn(mine, text_key(F.col(text)))
    return keyed.join(F.broadcast(drop) if few else drop, F.col(mine) == F.col(gone), "left_anti").drop(mine)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; see contamination and with_contamination."""
    found = with_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The contract by brute force: every window of every text against every window of every item.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
 starts AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS s FROM b WHERE len(w) > 0),
 windows AS (SELECT DISTINCT item, n, array_to_string(w[s + 1:s + n], ' ') AS g FROM starts),
 sizes AS (SELECT DISTINCT n FROM windows),
 places AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
 seen AS (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS g FROM places),
 met AS (SELECT doc_id, item, seen.n AS n, s FROM seen JOIN windows ON seen.n = windows.n AND seen.g = windows.g),
 each AS (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met),
 hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM each GROUP BY 1),
 named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM met GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""
