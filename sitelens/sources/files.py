"""The ``files`` table: file_id, path, content, size, missing_content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.paths import has_extension

#: Extensions of bundle text.
BUNDLE_EXTENSIONS = ("js", "mjs", "cjs", "css", "html", "htm", "json", "jsx", "ts", "tsx")
MOST_BYTES = 8 << 20


def files_from_table(df: DataFrame, file_id: str, path: str, content: str) -> DataFrame:
    """Any table with an id, a path and a text as files, ordered by path, then id."""
    return df.select(
        F.col(file_id).cast("string").alias("file_id"),
        F.col(path).alias("path"),
        F.coalesce(F.col(content), F.lit("")).alias("content"),
        F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("size"),
        F.col(content).isNull().alias("missing_content"),
    )


def files_from_dir(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder that isn't a dependency, build output or version control, under 8 MB."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    wanted = ~F.col("path").rlike(r"/(?:node_modules|dist|\.git)/") & (F.col("length") < MOST_BYTES)
    return raw.filter(wanted).select(
        F.sha2("path", 256).alias("file_id"),
        "path",
        F.decode("content", "UTF-8").alias("content"),
        F.col("length").alias("size"),
        F.lit(False).alias("missing_content"),
    )


def bundle_files(files: DataFrame) -> DataFrame:
    return files.filter(has_extension(F.col("path"), *BUNDLE_EXTENSIONS) & ~has_extension(F.col("path"), "map"))


def basename_index(files: DataFrame) -> DataFrame:
    """(name, path): the last path of each file name."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return files.groupBy(name.alias("name")).agg(F.max("path").alias("path"))


def pasted_kind(text: Column) -> Column:
    """html, map or js, by how a pasted text begins."""
    head = F.ltrim(text)
    return F.when(head.startswith("<"), "html").when(head.rlike(r'^\{[\s\S]*"(?:version|mappings|sections)"'), "map").otherwise("js")


def source_map_reference(content: Column) -> Column:
    """The last line comment's reference, unless a block comment names one."""
    line = F.get(F.reverse(F.regexp_extract_all(content, F.lit(r"//[#@] *sourceMappingURL=([^\s'\"]+)"), 1)), 0)
    block = F.get(F.regexp_extract_all(content, F.lit(r"/\*[#@] *sourceMappingURL=([^\s*]+) *\*/"), 1), 0)
    return F.coalesce(block, line)


def data_url_text(url: Column) -> Column:
    """The text of a data: address, base64 or percent-encoded; null for anything else."""
    body = F.regexp_extract(url, r"^data:[^,]*,(?s)(.*)$", 1)
    base64 = url.rlike(r"^data:[^,]*;base64,")
    return F.when(base64, F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")).when(url.startswith("data:"), F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))))


def with_companion(files: DataFrame) -> DataFrame:
    """Scripts with the path of the map beside them, if there is one."""
    maps = files.filter(has_extension(F.col("path"), "map")).select(F.col("path").alias("map_path"))
    scripts = files.filter(has_extension(F.col("path"), "js", "mjs", "cjs", "css"))
    return scripts.join(maps, F.concat("path", F.lit(".map")) == F.col("map_path"), "left")


def validated_maps(maps: DataFrame, content: str = "content") -> DataFrame:
    """Add valid and error to a table of source-map texts, a guard prefix allowed for."""
    text = F.regexp_replace(F.col(content), r"^\)\]\}'?[^\n]*\n", "")
    version = F.get_json_object(text, "$.version")
    has = F.get_json_object(text, "$.sources").isNotNull() | F.get_json_object(text, "$.sections").isNotNull()
    error = F.when(version.isNull() & ~F.coalesce(has, F.lit(False)), "not a JSON object").when(F.coalesce(version, F.lit("")) != "3", "unsupported version").when(~has, "no sources")
    return maps.withColumn("error", error).withColumn("valid", error.isNull())


def valid_wasm(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"\0asm"), F.lit(False))


def site_origin(files: DataFrame) -> DataFrame:
    """One row: the origin of the first canonical or og:url address, by path."""
    found = F.coalesce(
        F.nullif(F.regexp_extract("content", r"""(?i)<link[^>]+rel=["']canonical["'][^>]+href=["'](https?://[^/"']+)""", 1), F.lit("")),
        F.nullif(F.regexp_extract("content", r"""(?i)<meta[^>]+property=["']og:url["'][^>]+content=["'](https?://[^/"']+)""", 1), F.lit("")),
    )
    return files.select("path", found.alias("origin")).filter("origin is not null").agg(F.min_by("origin", "path").alias("origin"))
