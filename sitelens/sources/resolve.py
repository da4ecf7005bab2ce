"""References between files: headers, comments, paths, basenames, fetched content, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.paths import has_extension, normalize_relative_path, resolve_relative_path
from sitelens.sources.files import basename_index, data_url_text, source_map_reference


def map_reference(headers: Column, content: Column) -> Column:
    """A response's map: the header names it before the comments do. headers: MAP, names in lower case."""
    return F.coalesce(F.try_element_at(headers, F.lit("sourcemap")), F.try_element_at(headers, F.lit("x-sourcemap")), source_map_reference(content))


def resolved_references(files: DataFrame, reference: str = "reference") -> DataFrame:
    """Add resolved and how: data, absolute, path, basename or missing.

    Paths are tried relative to the file, then by file name; both are equality joins.
    """
    known = files.select(F.col("path").alias("_known")).distinct()
    names = basename_index(files).select(F.col("name").alias("_name"), F.col("path").alias("_named"))
    ref = F.col(reference)
    at = resolve_relative_path(F.col("path"), F.regexp_extract(ref, r"^([^?#]*)", 1))
    rows = files.filter(ref.isNotNull()).withColumn("_at", at).withColumn("_base", F.regexp_extract("_at", r"([^/]*)\z", 1))
    rows = rows.join(known, F.col("_at") == F.col("_known"), "left").join(names, F.col("_base") == F.col("_name"), "left")
    data, absolute = ref.startswith("data:"), ref.rlike(r"^(?i)(?:[a-z]+:)?//")
    how = F.when(data, "data").when(absolute, "absolute").when(F.col("_known").isNotNull(), "path").when(F.col("_named").isNotNull(), "basename").otherwise("missing")
    resolved = F.when(data | absolute, ref).otherwise(F.coalesce("_known", "_named"))
    return rows.withColumn("how", how).withColumn("resolved", resolved).drop("_known", "_name", "_named", "_at", "_base")


def inline_maps(files: DataFrame, reference: str = "reference") -> DataFrame:
    """(path, map_text) of maps that a data: address carries."""
    return files.select("path", data_url_text(F.col(reference)).alias("map_text")).filter("map_text is not null")


def with_fetched_content(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """Missing contents filled from a table (url, body) that was fetched before; only remote references match."""
    remote = F.when(F.col("missing_content") & F.col("path").rlike(r"^(?:https?:)?//"), F.col("path"))
    bodies = fetched.select(F.col("url").alias("_url"), F.col("body").alias("_body"))
    joined = files.join(bodies, remote == F.col("_url"), "left")
    return joined.withColumn("content", F.coalesce("content", "_body")).withColumn("missing_content", F.col("content").isNull()).drop("_url", "_body")


def tolerant_json(text: Column) -> Column:
    """The text's JSON as a VARIANT; else that of its outermost braces or brackets; else null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), F.try_parse_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1)))


def local_file_groups(files: DataFrame) -> DataFrame:
    """(kind, path, map_path): one snapshot of all files, or scripts with their maps and the rest singly.

    A snapshot has scripts, no maps, and is nested or has pages.
    """
    path = F.col("path")
    flags = files.agg(
        F.coalesce(F.bool_or(has_extension(path, "js", "mjs", "cjs")), F.lit(False)).alias("js"),
        F.coalesce(F.bool_or(has_extension(path, "map")), F.lit(False)).alias("maps"),
        F.coalesce(F.bool_or(path.contains("/") | has_extension(path, "html", "htm")), F.lit(False)).alias("site"),
    ).first()
    if flags.js and not flags.maps and flags.site:
        return files.select(F.lit("snapshot").alias("kind"), "path", F.lit(None).cast("string").alias("map_path"))
    maps = files.filter(has_extension(path, "map")).select(F.col("path").alias("map_path"))
    scripts = files.filter(~has_extension(path, "map")).select("path")
    paired = scripts.join(maps, F.concat("path", F.lit(".map")) == F.col("map_path"), "left")
    lone = maps.join(scripts, F.concat("path", F.lit(".map")) == F.col("map_path"), "left_anti")
    own = paired.select(F.when(F.col("map_path").isNotNull(), "pair").otherwise("single").alias("kind"), "path", "map_path")
    return own.unionByName(lone.select(F.lit("single").alias("kind"), F.col("map_path").alias("path"), F.lit(None).cast("string").alias("map_path")))


def manifest_parts(manifests: DataFrame, contents: DataFrame) -> DataFrame:
    """(chunk, file, lines, content) of split manifests, part texts joined by path.

    manifests: (path, content) with JSON ``{"parts": [{"file", "lines"}]}``; contents: (path, content).
    """
    parsed = manifests.select(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("chunk"), F.from_json("content", "parts array<struct<file string, lines long>>")["parts"].alias("parts"))
    each = parsed.select("chunk", F.explode("parts").alias("p")).select("chunk", "p.file", "p.lines")
    texts = contents.select(F.col("path").alias("_path"), F.col("content").alias("part_content"))
    return each.join(texts, F.concat_ws("/", "chunk", "file") == F.col("_path"), "left").drop("_path")


#: Directories that a project has at its top, and files that a rebuilt project writes itself.
PROJECT_ROOTS = "src app lib components hooks utils pages server client public assets styles tests test types scripts".split()
RESERVED_PATHS = ["package.json", "README.md", "tsconfig.json", "vite.config.ts", "vite.config.js", "index.html"]


def placeholder(path: Column) -> Column:
    """The text that stands for a source without content, as a comment of the file's language."""
    message = F.concat(F.lit("Recovered path "), path, F.lit(", but no source content was embedded in the source map."))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    json = F.concat(F.to_json(F.struct(F.lit(False).alias("recovered"), message.alias("message")), {"pretty": "true"}), F.lit("\n"))
    wrapped = lambda a, b: F.concat(F.lit(a), message, F.lit(b))
    styles = extension.isin("css", "scss", "sass", "less")
    return F.when(extension == "json", json).when(extension == "html", wrapped("<!-- ", " -->\n")).when(styles, wrapped("/* ", " */\n")).otherwise(wrapped("// ", "\n"))


def output_paths(files: DataFrame, path: str = "path", order: str | None = None) -> DataFrame:
    """Add output, the place of each file in a rebuilt project; repeated places get ``-2``, ``-3`` and so on, by ``order`` (the path).

    A single top directory that all files share goes, unless it is a project's own; what the
    project writes itself, and built files, go below ``recovered``; other files go below ``src``
    unless they begin with a project directory.
    """
    root = F.substring_index(F.col(path), "/", 1)
    keeps = F.col(path).isin(RESERVED_PATHS) | root.isin(PROJECT_ROOTS) | (root == "")
    shared = files.agg(F.when(~F.coalesce(F.bool_or(keeps), F.lit(True)) & (F.min(root) == F.max(root)), F.min(root)).alias("_shared"))
    plain = files.join(F.broadcast(shared), F.lit(True))  # one row
    cut = F.when(F.startswith(F.col(path), F.concat(F.col("_shared"), F.lit("/"))), F.substring(F.col(path), F.length("_shared") + 2, F.length(path))).otherwise(F.col(path))
    cut = F.coalesce(F.nullif(cut, F.lit("")), F.lit("recovered/unknown.js"))
    plain = plain.withColumn("_cut", cut)
    cut = F.col("_cut")
    set_aside = cut.isin(RESERVED_PATHS) | cut.rlike("^(?:dist|build)/")
    first = F.coalesce(F.get(F.filter(F.split(cut, "/"), lambda s: s != ""), 0), F.lit(""))
    placed = F.when(first.isin(PROJECT_ROOTS), cut).otherwise(F.concat(F.lit("src/"), cut))
    placed = F.when(placed.rlike(r"\.[A-Za-z0-9]+\z"), placed).otherwise(F.concat(placed, F.lit(".js")))
    plain = plain.withColumn("output", F.when(set_aside, F.concat(F.lit("recovered/"), cut)).otherwise(placed)).drop("_cut", "_shared")
    n = F.row_number().over(Window.partitionBy("output").orderBy(order or path))
    ending = F.regexp_extract("output", r"(\.[A-Za-z0-9]+)?\z", 0)
    stem = F.substring(F.col("output"), F.lit(1), F.length("output") - F.length(ending))
    plain = plain.withColumn("_n", n)
    return plain.withColumn("output", F.when(F.col("_n") == 1, F.col("output")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ending))).drop("_n")


def relative_specifier(source: Column, target: Column) -> Column:
    """The import specifier that leads from one file to another, both paths below one root."""
    here, there = F.split(normalize_relative_path(source), "/"), F.split(normalize_relative_path(target), "/")
    folders = F.slice(here, F.lit(1), F.size(here) - 1)
    same = F.transform(folders, lambda s, k: s.eqNullSafe(F.get(there, k)) & (k < F.size(there) - 1))
    shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    up = F.repeat(F.lit("../"), F.size(folders) - shared)
    down = F.array_join(F.slice(there, shared + 1, F.size(there)), "/")
    return F.concat(F.when(up == "", F.lit("./")).otherwise(up), down)
