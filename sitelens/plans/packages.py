"""Package inference from files, and what follows from it.

Evidence of five kinds becomes one long table; aggregation by package keeps distinct
files, the version of the best evidence and a score, from which rank and label come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import paths as P
from sitelens.operators import scoring
from sitelens.registry import query, table

#: Score and version priority of each kind of evidence.
SCORES = {"manifest": (100, 5), "node-modules": (96, 4), "versioned-map": (90, 3), "map": (72, 2), "declared": (55, 1), "import": (0, 0)}
MOST_EVIDENCE = 8

_IMPORT = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"'\n]+)["']"""


def import_specifiers(code: Column) -> Column:
    """Distinct specifiers of import, export-from, require and dynamic import."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(_IMPORT), 1))


def evidence(files: DataFrame) -> DataFrame:
    """(name, version, kind, file_id, detail, bytes) from paths, manifests, references and imports."""
    parts = []
    base = files.select("file_id", "path", "content", "size")
    by_path = base.withColumn("name", P.valid_package_name(P.package_of_path(F.col("path"))))
    parts.append(by_path.select("name", F.lit(None).cast("string").alias("version"), F.lit("node-modules").alias("kind"), "file_id", F.col("path").alias("detail"), "size"))
    manifest = base.filter(F.col("path").rlike(r"(?:^|/)package\.json\z"))
    parsed = manifest.withColumn("m", F.from_json("content", "name string, version string, dependencies map<string,string>"))
    parts.append(parsed.select(P.valid_package_name(F.col("m.name")).alias("name"), "m.version", F.lit("manifest").alias("kind"), "file_id", F.col("path").alias("detail"), "size"))
    declared = parsed.select("file_id", "path", F.explode("m.dependencies").alias("dep", "range"))
    parts.append(declared.select(P.valid_package_name(F.col("dep")).alias("name"), F.col("range").alias("version"), F.lit("declared").alias("kind"), "file_id", F.col("path").alias("detail"), F.lit(0).cast("long").alias("size")))
    maps = base.filter(F.col("path").endswith(".map")).select("file_id", F.explode(F.from_json("content", "sources array<string>")["sources"]).alias("reference"))
    found = maps.withColumn("c", P.coordinate(F.col("reference")))
    kind = F.when(F.col("c.version").isNotNull(), "versioned-map").otherwise("map")
    parts.append(found.select("c.name", "c.version", kind.alias("kind"), "file_id", F.col("reference").alias("detail"), F.lit(0).cast("long").alias("size")))
    code = base.filter(P.has_extension(F.col("path"), "js", "mjs", "cjs", "jsx", "ts", "tsx")).select("file_id", F.explode(import_specifiers(F.col("content"))).alias("specifier"))
    parts.append(code.select(P.package_of_specifier(F.col("specifier")).alias("name"), F.lit(None).cast("string").alias("version"), F.lit("import").alias("kind"), "file_id", F.col("specifier").alias("detail"), F.lit(0).cast("long").alias("size")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("name is not null").distinct()


def packages(found: DataFrame) -> DataFrame:
    """One row a package: score, label, version of the best evidence, files, bytes, import count."""
    score, priority = F.lit(0), F.lit(0)
    for kind, (s, p) in SCORES.items():
        score = F.when(F.col("kind") == kind, s).otherwise(score)
        priority = F.when(F.col("kind") == kind, p).otherwise(priority)
    rows = found.withColumn("base", score).withColumn("priority", priority)
    out = rows.groupBy("name").agg(
        F.max("base").alias("base"),
        F.count_distinct(F.when(F.col("kind") == "import", F.col("detail"))).alias("imports"),
        F.count_distinct(F.when(F.col("kind") == "node-modules", F.col("file_id"))).alias("exact_files"),
        F.sum(F.when(F.col("kind") == "node-modules", F.col("size")).otherwise(0)).alias("exact_bytes"),
        F.max_by("version", F.when(F.col("version").isNotNull(), F.struct("priority", "detail"))).alias("version"),
        F.count("*").alias("evidence"),
    )
    best = F.greatest("base", F.when(F.col("imports") > 0, scoring.import_score(F.col("imports"))).otherwise(0))
    return out.withColumn("score", best.cast("long")).withColumn("confidence", F.when(F.col("score") >= 80, "high").when(F.col("score") >= 40, "medium").otherwise("low")).drop("base")


@query("""
WITH p AS (SELECT p_partkey, p_size, p_retailprice, p_type, 30 + 2 * p_size - CASE WHEN p_type LIKE 'PROMO%' THEN 25 ELSE 0 END + CASE WHEN p_retailprice < 1000 THEN 15 ELSE 0 END AS raw FROM part)
SELECT p_partkey, CAST(least(100, greatest(0, raw)) AS BIGINT) AS score, CASE WHEN raw >= 90 THEN 'promote' WHEN raw >= 50 THEN 'review' ELSE 'leave' END AS action
FROM p ORDER BY least(100, greatest(0, raw)) DESC, p_partkey LIMIT 40
""")
def promotion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, penalties and caps, then the top 40."""
    raw = 30 + 2 * F.col("p_size") - F.when(F.col("p_type").startswith("PROMO"), 25).otherwise(0) + F.when(F.col("p_retailprice") < 1000, 15).otherwise(0)
    score = F.least(F.lit(100), F.greatest(F.lit(0), raw)).cast("long")
    action = F.when(raw >= 90, "promote").when(raw >= 50, "review").otherwise("leave")
    rows = table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), action.alias("action"))
    return rows.orderBy(F.desc("score"), "p_partkey").limit(40)


@query("""
WITH s AS (SELECT s_suppkey, count(*) AS parts, count(DISTINCT l_returnflag) AS kinds, avg(l_discount) AS risk FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1),
 r AS (SELECT *, round(least(0.98, greatest(0.05, 0.2 + least(0.5, parts / 1000.0) + 0.05 * kinds - risk)), 4) AS readiness FROM s)
SELECT CASE WHEN readiness >= 0.72 THEN 'ready' WHEN readiness >= 0.52 THEN 'review' ELSE 'blocked' END AS label, count(*) AS suppliers, CAST(sum(parts) AS BIGINT) AS parts FROM r GROUP BY 1
""")
def readiness_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("k"), F.avg("l_discount").alias("risk"))
    rows = table(spark, sf_dir, "supplier").join(items, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    parts, kinds = F.coalesce("n", F.lit(1)), F.coalesce("k", F.lit(0))
    raw = 0.2 + F.least(F.lit(0.5), parts / 1000.0) + 0.05 * kinds - F.coalesce("risk", F.lit(0.0))
    readiness = F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.05), raw)), 4)
    label = F.when(readiness >= 0.72, "ready").when(readiness >= 0.52, "review").otherwise("blocked")
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("suppliers"), F.sum(parts).alias("parts"))


@query("""
SELECT CASE WHEN url LIKE '%.js%' THEN 'script' WHEN regexp_matches(url, '/(en|de|fr|es)/') THEN 'article' ELSE 'other' END AS role, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
 regexp_matches(url, '[?]') AS has_query, count(*) AS pages FROM pages GROUP BY 1, 2, 3
""")
def role_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of an ordered list that holds decides."""
    u = F.col("url")
    role = F.when(u.contains(".js"), "script").when(u.rlike("/(en|de|fr|es)/"), "article").otherwise("other")
    return table(spark, sf_dir, "pages").groupBy(role.alias("role"), F.regexp_extract(u, "^([a-z]+)://", 1).alias("scheme"), u.contains("?").alias("has_query")).agg(F.count("*").alias("pages"))


@query("""
WITH s AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, string_split(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/')[1] AS root FROM pages)
SELECT host, count(*) AS pages, CASE WHEN count(DISTINCT root) = 1 THEN min(root) END AS single_root FROM s GROUP BY 1
""")
def singleton_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.get(F.split(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), "/"), 0)
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), root.alias("root"))
    return rows.groupBy("host").agg(F.count("*").alias("pages"), F.when(F.min("root") == F.max("root"), F.min("root")).alias("single_root"))


@query("""
SELECT page_id, url FROM pages WHERE contains(lower(url), 'utm_source') ORDER BY page_id LIMIT 40
""")
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive substring search, first 40 by id."""
    return table(spark, sf_dir, "pages").filter(F.lower("url").contains("utm_source")).orderBy("page_id").limit(40).select("page_id", "url")


@query("""
SELECT conv_id, count(*) AS statements, CAST(sum(length(text)) AS BIGINT) AS size, count(*) FILTER (role = 'user') AS calls, round(count(*) FILTER (role = 'user') / count(*), 4) AS share, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1
""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.count_if(F.col("role") == "user")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("statements"), F.sum(F.length("text")).cast("long").alias("size"), calls.alias("calls"), F.round(calls / F.count("*"), 4).alias("share"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")
    )


@query("""
SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS digest, CASE WHEN length(text) > 60 THEN left(text, 30) || '...' || right(text, 27) ELSE text END AS preview FROM documents
""")
def digest_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    preview = F.when(F.length(t) > 60, F.concat(F.left(t, F.lit(30)), F.lit("..."), F.right(t, F.lit(27)))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.left(F.sha2(F.coalesce(t, F.lit("")), 256), F.lit(16)).alias("digest"), preview.alias("preview"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, value FROM events)
SELECT CAST(epoch(start) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2
""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows; the same expression works on a stream with a watermark."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("at", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")
