"""Line-based splitting and path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.ranges import Step, fold_groups


def fragments(files: DataFrame, size: int = 5000) -> DataFrame:
    """(file_id, fragment, first_line, last_line, bytes): slices of so many lines."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    part = F.floor(F.col("at") / size).cast("long")
    return lines.groupBy("file_id", part.alias("fragment")).agg((F.min("at") + 1).alias("first_line"), (F.max("at") + 1).alias("last_line"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def sections(files: DataFrame, boundary: str) -> DataFrame:
    """(file_id, section, first_line, lines): a line that matches the boundary begins a section."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    order = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select("file_id", "at", F.sum(F.col("line").rlike(boundary).cast("int")).over(order).alias("section"))
    return marked.groupBy("file_id", "section").agg((F.min("at") + 1).alias("first_line"), F.count("*").alias("lines"))


def merge_tiny(groups: DataFrame, keys: list[str], order: str, size: str, tiny: Column) -> DataFrame:
    """A tiny group joins the last one before it that isn't; leading tiny ones stay together."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.coalesce(F.max(F.when(~tiny, F.col(order))).over(window), F.lit(-1))
    return groups.withColumn("_into", anchor).groupBy(*keys, "_into").agg(F.min(order).alias(order), F.sum(size).alias(size), F.count("*").alias("groups")).drop("_into")


def common_prefix(paths: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The longest common directory of each key's paths: the first and last of them decide."""
    ends = paths.groupBy(*keys).agg(F.split(F.min(path), "/").alias("_first"), F.split(F.max(path), "/").alias("_last"))
    same = F.transform(F.slice("_first", F.lit(1), F.size("_first") - 1), lambda s, k: s.eqNullSafe(F.get("_last", k)))
    n = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    return ends.select(*keys, F.array_join(F.slice("_first", F.lit(1), n), "/").alias("prefix"))


def collapsed_prefixes(paths: DataFrame, path: str, size: str) -> DataFrame:
    """Rolled-up prefixes whose chains of only children are left out: (prefix, depth, files, bytes)."""
    parts = F.split(path, "/")
    step = F.struct
    each = paths.select(F.col(size).alias("_size"), F.explode(F.transform(parts, lambda _, k: step((k + 1).alias("depth"), F.array_join(F.slice(parts, F.lit(1), k + 1), "/").alias("prefix"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("parent")))).alias("p"))
    rolled = each.groupBy("p.prefix", "p.depth", "p.parent").agg(F.count("*").alias("files"), F.sum("_size").alias("bytes"))
    parents = rolled.select(F.col("prefix").alias("_prefix"), F.col("files").alias("_files"))
    joined = rolled.join(parents, F.col("parent") == F.col("_prefix"), "left")
    children = F.count("*").over(Window.partitionBy("parent"))
    return joined.withColumn("_siblings", children).filter((F.col("_siblings") > 1) | F.col("_files").isNull() | (F.col("_files") > F.col("files"))).select("prefix", "depth", "files", "bytes")


def _counted(files: DataFrame) -> DataFrame:
    """(file_id, at, line) of files with content."""
    return files.select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))


def _part_rows(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("file_id", "part").agg((F.min("at") + 1).alias("first_line"), (F.max("at") + 1).alias("last_line"))


def sub_sections(files: DataFrame, declaration: str, target: int = 5000, longest: int = 200) -> DataFrame:
    """(file_id, part, first_line, last_line): cuts at the first declaration after ``target`` lines.

    A declaration may be cut at if its line is shorter than ``longest`` and the line before it
    is blank or closes a block.
    """
    lines = _counted(files)
    before = F.trim(F.lag("line").over(Window.partitionBy("file_id").orderBy("at")))
    able = F.col("line").rlike(declaration) & (F.length("line") < longest) & before.isin("", "}", "});")
    marked = lines.select("file_id", "at", F.coalesce(able, F.lit(False)).cast("int").alias("able"))

    def step(state: tuple | None, able: int) -> tuple[tuple, int]:
        part, held = state or (0, 0)
        part, held = (part + 1, 0) if able and held >= target else (part, held)
        return (part, held + 1), part

    return _part_rows(fold_groups(marked, ["file_id"], ["at"], "able", step, "part"))


def bounded_parts(most_lines: int = 2000, most_bytes: int = 512 << 10) -> Step:
    """A new part begins when so many lines are held or the next would take a started part over the bytes."""

    def step(state: tuple | None, size: int) -> tuple[tuple, int]:
        part, lines, held = state or (0, 0, 0)
        if lines and (lines >= most_lines or held + size > most_bytes):
            part, lines, held = part + 1, 0, 0
        return (part, lines + 1, held + size), part

    return step


def bounded_fragments(files: DataFrame, most_lines: int = 2000, most_bytes: int = 512 << 10) -> DataFrame:
    """(file_id, part, first_line, last_line) of files that can't be parsed: cut by lines and bytes alone."""
    sized = _counted(files).select("file_id", "at", (F.octet_length("line") + 1).alias("size"))
    return _part_rows(fold_groups(sized, ["file_id"], ["at"], "size", bounded_parts(most_lines, most_bytes), "part"))
