"""Linking parts into bundles: what an entry needs, in which order, and what is missing.

The parts' imports are a graph with cycles. Strongly connected parts are found by colours
that run forward and back, levels by taking away what needs nothing that is left; both go in
checkpointed rounds over the frontier, as many as the graph is deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.durable import durable
from sitelens.operators.scoring import closure


def _spread(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, colour): the largest colour of all that reach a node over edges (src, dst)."""
    changed = colours
    while not changed.isEmpty():
        sent = changed.join(edges.hint("merge"), F.col("node") == F.col("src")).groupBy(F.col("dst").alias("_node")).agg(F.max("colour").alias("_colour"))
        met = colours.join(sent.hint("merge"), F.col("node") == F.col("_node"), "left")
        met = durable(met.select("node", F.greatest("colour", "_colour").alias("colour"), F.coalesce(F.col("_colour") > F.col("colour"), F.lit(False)).alias("moved")))
        colours, changed = met.select("node", "colour"), met.filter("moved").select("node", "colour")
    return colours


def _onward(edges: DataFrame) -> DataFrame:
    """The edges whose ends are a beginning of edges, too."""
    begins = edges.select(F.col("src").alias("_begin")).distinct()
    return edges.join(begins.hint("merge"), F.col("dst") == F.col("_begin"), "left_semi")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges among nodes that may lie on a cycle: what nothing points to, or points to nothing, goes until no more does."""
    turn = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    count = None
    while count != (count := edges.count()):
        edges = durable(turn(_onward(turn(_onward(edges)))))
    return edges


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of each node: the largest node of those that reach it and that it reaches.

    Edges (src, dst) whose ends aren't nodes, repeated and null ones don't count.
    """
    every = durable(nodes.select("node").filter("node is not null").distinct())
    ends = every.select(F.col("node").alias("_node"))
    inner = edges.filter("src != dst").select("src", "dst").distinct()
    inner = inner.join(ends.hint("merge"), F.col("src") == F.col("_node"), "left_semi").join(ends.hint("merge"), F.col("dst") == F.col("_node"), "left_semi")
    inner, found = _trimmed(durable(inner)), None
    while not inner.isEmpty():
        colours = _spread(inner.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct(), inner)
        of = lambda end, into: colours.select(F.col("node").alias(end), F.col("colour").alias(into)).hint("merge")  # noqa: B023, E731
        same = inner.join(of("src", "_a"), "src").join(of("dst", "_b"), "dst").filter("_a = _b")
        back = durable(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = closure(back, colours.filter("node = colour").select(F.col("node").alias("root")))
        mine = durable(reached.select("node", F.col("root").alias("component")))
        found = mine if found is None else found.unionByName(mine)
        gone = mine.select(F.col("node").alias("_gone")).hint("merge")
        inner = inner.join(gone, F.col("src") == F.col("_gone"), "left_anti").join(gone, F.col("dst") == F.col("_gone"), "left_anti")
        inner = _trimmed(durable(inner))
    if found is None:
        return every.select("node", F.col("node").alias("component"))
    # What lies on no cycle is alone.
    found = found.select(F.col("node").alias("_node"), "component")
    return every.join(found.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", F.coalesce("component", "node").alias("component"))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, level): 0 for what needs no other component, else one more than the highest that it needs.

    An edge (src, dst) says that src needs dst; the nodes of a component share its level.
    A component that still begins an edge after t times leaving out the edges whose ends
    begin none is above level t.
    """
    found = durable(components(nodes, edges))
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")).hint("merge")
    needs = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").filter("_src != _dst")
    needs, level, above = durable(needs.select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()), 0, None
    while not needs.isEmpty():
        level += 1
        mine = needs.select(F.col("src").alias("_component"), F.lit(level).alias("level")).distinct()
        above = mine if above is None else above.unionByName(mine)
        needs = durable(_onward(needs))
    if above is None:
        return found.withColumn("level", F.lit(0))
    above = above.groupBy("_component").agg(F.max("level").alias("level"))
    return found.join(above.hint("merge"), F.col("component") == F.col("_component"), "left").select("node", "component", F.coalesce("level", F.lit(0)).alias("level"))


def import_edges(statements: DataFrame) -> DataFrame:
    """(src, dst, dynamic) of the static and dynamic ``./`` imports of statements whose file_id is the file's path."""
    named = lambda c, dynamic: statements.select(F.col("file_id").alias("src"), F.explode(c).alias("dst"), F.lit(dynamic).alias("dynamic"))
    both = named("imports", False).unionByName(named("dynamic_imports", True)).filter(F.startswith("dst", F.lit("./")))
    return both.select("src", F.regexp_replace("dst", r"^(\./)+", "").alias("dst"), "dynamic").distinct()


def is_page(content: Column) -> Column:
    """Whether an asset that was asked for came back as a page instead."""
    return F.contains(F.substring(F.coalesce(content, F.lit("")), 1, 64), F.lit("<!DOCTYPE"))


def available(parts: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(path, content, origin): the parts, and of the assets those that no part stands for and that are no pages."""
    own = parts.select("path", "content", F.lit("part").alias("origin"))
    if assets is None:
        return own
    more = assets.filter(~is_page(F.col("content"))).join(parts.select("path").hint("merge"), "path", "left_anti")
    return own.unionByName(more.select("path", "content", F.lit("asset").alias("origin")))


def _reached(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(root, node): an entry and all it imports, statically or not."""
    return closure(edges.select("src", "dst").distinct(), entries.select(F.col("entry").alias("root")))


def bundles(files: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, content, parts): each entry's file with all it reaches, as one text.

    files has path and content, edges is of import_edges, entries has entry. Parts go by
    level, component and path, so what is needed comes first and the parts of a cycle stand
    together. Null contents are empty; an entry without a file has what else it reaches.
    """
    placed = levels(files.select(F.col("path").alias("node")), edges)
    held = _reached(edges, entries).join(placed.hint("merge"), "node").join(files.select(F.col("path").alias("node"), "content").hint("merge"), "node")
    row = F.struct("level", "component", "node", F.coalesce("content", F.lit("")).alias("content"))
    whole = held.groupBy(F.col("root").alias("entry")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = lambda c, mark: F.array_join(F.transform("rows", lambda x: x[c]), mark)
    return whole.select("entry", joined("content", "\n").alias("content"), joined("node", ",").alias("parts"))


def missing(files: DataFrame, edges: DataFrame, entries: DataFrame, stubs: DataFrame | None = None) -> DataFrame:
    """(entry, target, source): dynamic imports among all that an entry reaches which neither a file nor a stub answers.

    An entry that is itself no file is missing without a source.
    """
    known = files.select("path")
    wanted = _reached(edges, entries).join(edges.filter("dynamic").hint("merge"), F.col("node") == F.col("src")).select(F.col("root").alias("entry"), F.col("dst").alias("target"), F.col("src").alias("source"))
    wanted = wanted.unionByName(entries.select("entry", F.col("entry").alias("target"), F.lit(None).cast("string").alias("source")))
    lost = wanted.join(known.hint("merge"), F.col("target") == F.col("path"), "left_anti")
    if stubs is not None:
        lost = lost.join(stubs.select(F.col("path").alias("_stub")).hint("merge"), F.col("target") == F.col("_stub"), "left_anti")
    return lost.distinct()
