"""Evidence, scores, ranks and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.durable import durable


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")


def import_score(n: Column) -> Column:
    """Score of a package known by n import specifiers alone."""
    return F.least(F.lit(48), 18 + 12 * n)


def site_score(n: Column) -> Column:
    """Score of a package known by n addresses alone."""
    return F.least(F.lit(28), 10 + 3 * n)


def signal_confidence(n: Column) -> Column:
    """Confidence of a runtime signal with n pieces of evidence."""
    return F.round(F.least(F.lit(0.95), 0.45 + 0.16 * n), 6)


def scoreboard(evidence: DataFrame, subject: list[str], candidate: str, weight: str) -> DataFrame:
    """Sum of weights by subject and candidate, with the rank: score first, then the name."""
    scores = evidence.groupBy(*subject, candidate).agg(F.round(F.sum(weight), 4).alias("score"), F.count("*").alias("evidence"))
    order = Window.partitionBy(*subject).orderBy(F.desc("score"), candidate)
    return scores.withColumn("rank", F.row_number().over(order))


def first_by(rows: DataFrame, keys: list[str], order: list[Column | str], most: int = 1) -> DataFrame:
    """The first rows of each key in an order: keep-first, keep-last (descending) and top-k."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def quota_union(rows: DataFrame, parts: list[tuple[str, Column, list[Column], int]]) -> DataFrame:
    """Top-k lists of several kinds, one below the other: (kind, filter, order, quota).

    One pass tags each row with the kinds it is of; each kind's order is a rank of its own.
    """
    kinds = F.array_compact(F.array(*[F.when(condition, F.lit(k)) for k, (_, condition, _, _) in enumerate(parts)]))
    tagged = rows.withColumn("_kind", F.explode(kinds))
    rank, most, name = F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("string")
    for k, (kind, _, order, quota) in enumerate(parts):
        here = F.col("_kind") == k
        rank = F.when(here, F.row_number().over(Window.partitionBy("_kind").orderBy(*order))).otherwise(rank)
        most, name = F.when(here, F.lit(quota)).otherwise(most), F.when(here, F.lit(kind)).otherwise(name)
    ranked = tagged.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    return ranked.withColumn("kind", name).drop("_kind", "_rank")


#: Names of bundled require functions and the vendor they stand for, in order; ``=`` is the whole name.
VENDOR_REQUIRES = [
    ("=require_react_production", "react"),
    ("=require_react", "react"),
    ("=require_scheduler_production", "react-dom"),
    ("=require_scheduler", "react-dom"),
    ("=require_react_dom_production", "react-dom"),
    ("=require_react_dom", "react-dom"),
    ("=require_react_dom_client_production", "react-dom"),
    ("=require_client", "react-dom"),
    ("=require_react_jsx_runtime_production", "react-jsx"),
    ("=require_jsx_runtime", "react-jsx"),
    ("require_react_compiler_runtime", "react-compiler"),
    ("=require_compiler_runtime", "react-compiler"),
    ("require_use_sync_external_store", "sync-external-store"),
    ("=require_shim", "sync-external-store"),
    ("require_with_selector", "sync-external-store"),
    ("require_typeof", "oxc-runtime-helpers"),
    ("require_toPrimitive", "oxc-runtime-helpers"),
    ("require_toPropertyKey", "oxc-runtime-helpers"),
    ("require_defineProperty", "oxc-runtime-helpers"),
    ("require_objectSpread2", "oxc-runtime-helpers"),
    ("require_objectWithoutProperties", "oxc-runtime-helpers"),
    ("require_objectWithoutPropertiesLoose", "oxc-runtime-helpers"),
    ("require_usingCtx", "oxc-runtime-helpers"),
    ("require_OverloadYield", "oxc-runtime-helpers"),
    ("require_awaitAsyncGenerator", "oxc-runtime-helpers"),
    ("require_wrapAsyncGenerator", "oxc-runtime-helpers"),
    ("require_asyncIterator", "oxc-runtime-helpers"),
    ("require_asyncGeneratorDelegate", "oxc-runtime-helpers"),
]


def vendor_of(name: Column) -> Column:
    """The vendor that a bundled require function stands for; null if it is none's."""
    out = F.lit(None).cast("string")
    for begin, vendor in reversed(VENDOR_REQUIRES):
        fits = name == begin[1:] if begin.startswith("=") else F.startswith(name, F.lit(begin))
        out = F.when(fits, vendor).otherwise(out)
    return out


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): everything reachable from the roots over edges (src, dst), roots too.

    Each round joins the frontier only, leaves out what is already known and is checkpointed.
    Neither the edges nor what is known grow small by the sizes that Spark guesses, so they are not broadcast.
    """
    known = frontier = durable(roots.select(F.col("root"), F.col("root").alias("node"), F.lit(0).alias("depth")).distinct())
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges.hint("merge"), F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct()
        seen = known.select(F.col("root").alias("_root"), F.col("node").alias("_node"))
        frontier = durable(step.join(seen.hint("merge"), (F.col("root") == F.col("_root")) & (F.col("node") == F.col("_node")), "left_anti"))
        known = known.unionByName(frontier)
    return known
