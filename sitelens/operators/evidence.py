"""Merging package evidence: bounded, ordered summaries of each package whatever the partitioning.

Every item has a position; "first" means the least one. Items are reduced by key before
they are shuffled by package, and the ranks that bound a list are limited on both sides of
the shuffle, so that a package with most of the items is no burden for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ITEMS, MOST_PLACES, MOST_CANDIDATES = 20, 12, 20
ANY_VERSION = "*"


def _given(column: str) -> Column:
    """A text, with the empty one as null."""
    return F.when(F.col(column) != "", F.col(column))


def merged_dependencies(items: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(name, version, evidence, items, n_items): one row a package of (name, version, type, detail, file, position).

    The version is the first that is given and not ``*``, or else ``*``; evidence is the
    first item's detail; items are the first ``most`` distinct (type, detail, file, version)
    by position, n_items counts all of these. Items without a name are left out, missing
    types are ``fingerprint``; ties of position go by the item's own values.
    """
    rows = items.filter(_given("name").isNotNull()).select(
        "name", _given("version").alias("version"), F.coalesce(_given("type"), F.lit("fingerprint")).alias("type"),
        F.coalesce("detail", F.lit("")).alias("detail"), _given("file").alias("file"), F.col("position").cast("long").alias("position"),
    )
    one = ["type", "detail", "file", "version"]
    distinct = rows.groupBy("name", *one).agg(F.min("position").alias("position"))
    at = F.struct("position", *one)
    known = (F.col("version") != ANY_VERSION) & F.col("version").isNotNull()
    totals = distinct.groupBy("name").agg(
        F.coalesce(F.min_by("version", F.when(known, at)), F.lit(ANY_VERSION)).alias("version"),
        F.coalesce(F.min_by(_given("detail"), at), F.lit("package evidence")).alias("evidence"),
        F.count("*").alias("n_items"),
    )
    rank = F.row_number().over(Window.partitionBy("name").orderBy("position", *one))
    first = distinct.withColumn("rank", rank).filter(F.col("rank") <= most)
    first = first.groupBy(F.col("name").alias("_name")).agg(F.array_sort(F.collect_list(F.struct("rank", *one))).alias("items"))
    out = totals.join(first, F.col("name") == F.col("_name"))
    return out.select("name", "version", "evidence", F.transform("items", lambda x: F.struct(*[x[c].alias(c) for c in one])).alias("items"), "n_items")


def compacted_evidence(items: DataFrame, most: int = MOST_PLACES) -> DataFrame:
    """(package, file, version, types, weight, rank): a package's places by falling weight, the first ``most``.

    A place is a file and version; its types are joined by ``+`` in order of first
    position, its weights (missing or 0: 1) are summed. Equal weights go by first position.
    """
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, 1).otherwise(F.col("weight"))
    each = items.filter(_given("package").isNotNull()).groupBy("package", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("version", F.lit("")).alias("version"), "type")
    each = each.agg(F.sum(weight).alias("weight"), F.min("position").alias("position"))
    types = F.transform(F.array_sort(F.collect_list(F.struct("position", "type"))), lambda x: x["type"])
    places = each.groupBy("package", "file", "version").agg(F.array_join(types, "+").alias("types"), F.sum("weight").alias("weight"), F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("weight"), "position", "file", "version"))
    return places.withColumn("rank", rank).filter(F.col("rank") <= most).select("package", "file", "version", "types", "weight", "rank")


def vendor_candidates(items: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(package, confidence, versions, places): the packages of the largest summed weights, equal ones by name.

    versions are joined by a comma in order of first position; places is the number of
    compacted ones, bounded as these are.
    """
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, 1).otherwise(F.col("weight"))
    rows = items.filter(_given("package").isNotNull())
    each = rows.groupBy("package", _given("version").alias("version")).agg(F.sum(weight).alias("weight"), F.min("position").alias("position"))
    versions = F.transform(F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("position", "version")))), lambda x: x["version"])
    totals = each.groupBy("package").agg(F.round(F.sum("weight")).cast("long").alias("confidence"), F.array_join(versions, ",").alias("versions"))
    totals = totals.orderBy(F.desc("confidence"), "package").limit(most)
    counts = compacted_evidence(rows).groupBy(F.col("package").alias("_package")).agg(F.count("*").alias("places"))
    return totals.join(counts, F.col("package") == F.col("_package")).drop("_package")
