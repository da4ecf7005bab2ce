"""Queries over web-application files made from the ``part`` table, one file or more a part.

What goes in is written as expressions that Spark and SQL read alike, so both sides see the
same files. What has to come out is computed by the SQL from the numbers and words that the
files were made of, never by parsing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.durable import durable
from sitelens.functions import html as H
from sitelens.functions import paths as P
from sitelens.functions import text as X
from sitelens.operators import fingerprints as R
from sitelens.operators import lines as L
from sitelens.operators import modules as M
from sitelens.operators import scoring
from sitelens.operators import webpack as W
from sitelens.plans import packages as K
from sitelens.registry import query, spread, table
from sitelens.sources import files as S
from sitelens.sources import resolve
from sitelens.sources import sourcemaps as V

#: A part's key k, size n (1 to 50) and two words a and b.
_PARTS = "SELECT p_partkey AS k, p_size AS n, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part"


def _parts(spark: SparkSession, sf_dir: str, **made: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS n", "split_part(p_name, ' ', 1) AS a", "split_part(p_name, ' ', 2) AS b")
    return spread(rows, "k").selectExpr("*", *[f"{text} AS {name}" for name, text in made.items()])


def _sql(select: str, **made: str) -> str:
    columns = "".join(f", {text} AS {name}" for name, text in made.items())
    return f"WITH p AS ({_PARTS}), f AS (SELECT *{columns} FROM p) {select}"


_PATHS = {
    "path": "CASE k % 4 WHEN 0 THEN 'webpack:///./src/../' || a || '//f' || k || '?.js' WHEN 1 THEN 'file:///C:' || chr(92) || a || chr(92) || b || k || '.ts' WHEN 2 THEN './' ELSE 'https://h.org/' || a || '/' || k || '.js' END",
    "other": "CASE k % 3 WHEN 0 THEN a || '/b/../c' || k || '/./' || b WHEN 1 THEN '../../' || a || k ELSE a || '//' || b || k || '/' END",
}


@query(_sql("""SELECT k, path, CASE k % 4 WHEN 0 THEN 'src/' || a || '/f' || k || '_.js' WHEN 1 THEN 'C_/' || a || '/' || b || k || '.ts' WHEN 2 THEN 'unknown' ELSE 'h.org/' || a || '/' || k || '.js' END AS sanitized,
 CASE k % 3 WHEN 0 THEN a || '/c' || k || '/' || b WHEN 1 THEN a || k ELSE a || '/' || b || k END AS normalized,
 CASE k % 3 WHEN 0 THEN a || '/c' || k WHEN 1 THEN '' ELSE a END AS directory FROM f""", **_PATHS))  # fmt: skip
def sanitize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_PATHS)
    return rows.select("k", "path", P.sanitize_path(F.col("path")).alias("sanitized"), P.normalize_relative_path(F.col("other")).alias("normalized"), P.dirname(F.col("other")).alias("directory"))


_SPECIFIER = {
    "specifier": "CASE k % 9 WHEN 0 THEN '@s' || a || '/' || b || k || '/sub?x' WHEN 1 THEN a || k || '/fp' WHEN 2 THEN './' || a WHEN 3 THEN 'fs' WHEN 4 THEN 'node:' || a WHEN 5 THEN '@/' || a WHEN 6 THEN 'virtual:' || a WHEN 7 THEN a || '-' || k ELSE 'Bad ' || a END"
}


@query(_sql("SELECT k, specifier, CASE k % 9 WHEN 0 THEN '@s' || a || '/' || b || k WHEN 1 THEN a || k WHEN 7 THEN a || '-' || k END AS package FROM f", **_SPECIFIER))
def specifier_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, **_SPECIFIER).select("k", "specifier", P.package_of_specifier(F.col("specifier")).alias("package"))


_REFERENCE = {
    "reference": "CASE k % 6 WHEN 0 THEN 'npm:@s/' || a || '@1.' || n || '.3/index.js' WHEN 1 THEN 'https://unpkg.com/' || a || k || '@0.' || n || '.2/build/x.js' WHEN 2 THEN 'webpack:///./node_modules/' || b || k || '/index.js'"
    " WHEN 3 THEN 'x/.vite/deps/' || a || '.js' WHEN 4 THEN 'https://cdn.jsdelivr.net/npm/@s/' || b || '@' || n || '/x.js' ELSE 'src/' || a || '.js' END"
}


@query(_sql("""SELECT k, reference, CASE k % 6 WHEN 0 THEN '@s/' || a WHEN 1 THEN a || k WHEN 2 THEN b || k WHEN 3 THEN a WHEN 4 THEN '@s/' || b END AS name,
 CASE k % 6 WHEN 0 THEN '1.' || n || '.3' WHEN 1 THEN '0.' || n || '.2' WHEN 4 THEN CAST(n AS VARCHAR) END AS version FROM f""", **_REFERENCE))  # fmt: skip
def coordinate_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_REFERENCE).withColumn("c", P.coordinate(F.col("reference")))
    return rows.select("k", "reference", "c.name", "c.version")


_NESTED = {
    "path": "CASE k % 5 WHEN 0 THEN 'app/node_modules/' || a || k || '/lib/i.js' WHEN 1 THEN 'node_modules/x/node_modules/@s/' || b || k || '/i.js' WHEN 2 THEN 'src/' || a || '.js' WHEN 3 THEN 'node_modules//' || a || '/' ELSE 'a' || chr(92) || 'node_modules' || chr(92) || b || chr(92) || 'x.js' END"
}


@query(_sql("SELECT k, path, CASE k % 5 WHEN 0 THEN a || k WHEN 1 THEN '@s/' || b || k WHEN 3 THEN a WHEN 4 THEN b END AS package FROM f", **_NESTED))
def package_of_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, **_NESTED).select("k", "path", P.package_of_path(F.col("path")).alias("package"))


_GLOB = {"path": "CASE k % 4 WHEN 0 THEN 'src/' || a || '/b/x' || k || '.js' WHEN 1 THEN 'src/x' || k || '.js' WHEN 2 THEN 'src/' || a || '/x.ts' ELSE 'lib/src/' || a || '/x.js' END"}


@query(_sql("SELECT k, path, k % 4 = 0 AS matched FROM f", **_GLOB))
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, **_GLOB).select("k", "path", P.glob_matches(F.col("path"), "src/**/x*.js").alias("matched"))


_PAGE = {
    "html": "'<html><head><title> ' || a || ' ' || k || ' </title><meta name=' || chr(39) || 'a' || chr(39) || ' content=' || chr(39) || '1' || chr(39) || '><meta content=\"' || b || ' > z\" property=\"og:x\"><meta name=a content=' || n || '>"
    "<link rel=\"stylesheet\" href=\"/s' || k || '.css?v=1\"><script src=\"' || CASE k % 3 WHEN 0 THEN '/_next/' WHEN 1 THEN '/_nuxt/' ELSE '/' END || a || '.js\"></script><script>let x = ' || k || ';</script></head><body><p>' || b || '</p></body></html>'"
}


@query(_sql("""SELECT k, a || ' ' || k AS title, '{"a":"' || n || '","og:x":"' || b || ' > z"}' AS meta, 'let x = ' || k || ';' AS inline, CASE k % 3 WHEN 0 THEN '/_next/' WHEN 1 THEN '/_nuxt/' ELSE '/' END || a || '.js' AS scripts,
 '/s' || k || '.css?v=1' AS sheets, '<p>' || b || '</p>' AS body, CASE k % 3 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'nuxt' ELSE 'unknown' END AS framework FROM f"""))  # fmt: skip
def html_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, joined = F.col("html"), lambda c: F.array_join(c, ",")
    return _parts(spark, sf_dir, **_PAGE).select(
        "k", H.tag_text(h, "title").alias("title"), F.to_json(H.meta_tags(h)).alias("meta"), joined(H.inline_scripts(h)).alias("inline"), joined(H.linked_scripts(h)).alias("scripts"),
        joined(H.stylesheets(h)).alias("sheets"), H.body(h).alias("body"), H.framework(h).alias("framework"),
    )


_ISLANDS = {
    "html": "'<p>x</p><astro-island component-url=\"/_a/my-' || a || '.B' || (k % 40) || '.js\" component-export=\"' || CASE k % 2 WHEN 0 THEN 'default' ELSE 'Own' || k END || '\" renderer-url=\"/' || CASE k % 3 WHEN 0 THEN 'client.C' WHEN 1 THEN 'vue' ELSE 'x' END || '.js\" props=\"{&quot;n&quot;:' || n || '}\"></astro-island>'",
}


@query(_sql("""SELECT k, CASE k % 2 WHEN 0 THEN 'My' || upper(substr(a, 1, 1)) || substr(a, 2) ELSE 'Own' || k END AS component, CASE k % 3 WHEN 0 THEN 'react' WHEN 1 THEN 'vue' ELSE 'unknown' END AS renderer, 'load' AS directive, '{"n":' || n || '}' AS props FROM f"""))
def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.island_rows(_parts(spark, sf_dir, **_ISLANDS).select("k", "html"))
    return rows.select("k", "component", "renderer", "directive", "props")


@query(_sql("""SELECT f.k AS page_id, CASE f.k % 2 WHEN 0 THEN 'My' || upper(substr(f.a, 1, 1)) || substr(f.a, 2) ELSE 'Own' || f.k END AS component, g.file_id
 FROM f LEFT JOIN (SELECT a, k % 40 AS m, min(k) AS file_id FROM f WHERE k % 3 = 0 GROUP BY 1, 2) g ON g.a = f.a AND g.m = f.k % 40"""))  # fmt: skip
def island_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _parts(spark, sf_dir, **_ISLANDS).withColumnRenamed("k", "page_id")
    files = _parts(spark, sf_dir).filter("k % 3 = 0").selectExpr("k AS file_id", "'_a/my-' || a || '.B' || (k % 40) || '.js' AS path")
    return H.island_files(pages, files).select("page_id", "component", "file_id")


_CSS = {"css": "':root{--main: #' || k || '; --gap:' || n || 'px;} /* --not: 1; */ a:hover{--main: ' || a || ';font-family:' || chr(39) || b || chr(39) || ', serif} b{font-family:Mono' || n || '}'"}


@query(_sql("""SELECT k, '{"--gap":"' || n || 'px","--main":"' || a || '"}' AS properties, b || '|Mono' || n AS fonts FROM f"""))
def css_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    css, declared = F.col("css"), F.col("declared")
    rows = _parts(spark, sf_dir, **_CSS).withColumn("declared", H.declarations(css))  # read twice
    return rows.select("k", F.to_json(H.css_properties(css, declared)).alias("properties"), F.array_join(H.font_families(css, declared), "|").alias("fonts"))


_SCRIPT = {
    "content": "CASE k % 5 WHEN 0 THEN 'x' || chr(10) || '//# sourceMappingURL=' || a || '.map' || chr(10) || '//# sourceMappingURL=' || b || k || '.map' WHEN 1 THEN '//# sourceMappingURL=' || a || '.map' || chr(10) || '/*# sourceMappingURL=' || k || '.map */'"
    " WHEN 2 THEN 'none ' || a WHEN 3 THEN '  <p>' || a || '</p>' ELSE '{\"version\":3,\"sources\":[\"' || a || '\"]}' END"
}


@query(_sql("SELECT k, CASE k % 5 WHEN 0 THEN b || k || '.map' WHEN 1 THEN k || '.map' END AS reference, CASE k % 5 WHEN 3 THEN 'html' WHEN 4 THEN 'map' ELSE 'js' END AS kind FROM f"))
def source_map_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_SCRIPT)
    return rows.select("k", S.source_map_reference(F.col("content")).alias("reference"), S.pasted_kind(F.col("content")).alias("kind"))


def _digit(n: Column) -> Column:
    """One base-64 VLQ digit of a number from 0 to 15."""
    return F.substring(F.lit("ACEGIKMOQSUWYace"), n + 1, F.lit(1))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of n lines. Line i has i % 3 + 1 segments, the first at column i % 10, the others 5 further each;
    every seventh line moves on to the next source; second segments have names."""

    def segment(i: Column, j: Column) -> Column:
        column = F.when(j == 0, i % 10).otherwise(F.lit(5))
        source = ((j == 0) & (i % 7 == 6)).cast("int")
        line, across = F.lit(1), F.when(j == 0, F.col("k") % 16).otherwise(F.lit(0))
        name = F.when(j == 1, _digit(F.lit(1))).otherwise(F.lit(""))
        return F.concat(*[_digit(x.cast("int")) for x in (column, source, line, across)], name)

    rows = _parts(spark, sf_dir)
    every = F.sequence(F.lit(0), F.col("n") - 1)
    lines = F.transform(every, lambda i: F.array_join(F.transform(F.sequence(F.lit(0), i % 3), lambda j: segment(i, j)), ","))
    code = F.transform(every, lambda i: F.repeat(F.lit("x"), (i % 10 + 5 * (i % 3) + 4).cast("int")))
    sources = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda s: F.concat(F.lit("s"), s.cast("string"), F.lit(".js")))
    names = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda s: F.concat(F.lit("n"), s.cast("string")))
    one = F.to_json(F.struct(F.lit(3).alias("version"), sources.alias("sources"), names.alias("names"), F.array_join(lines, ";").alias("mappings")))
    return rows.select(F.col("k").cast("string").alias("map_id"), one.alias("content"), F.array_join(code, "\n").alias("code"))


#: The mappings of _maps from their numbers alone.
_MAPPINGS = f"""WITH p AS ({_PARTS}), l AS (SELECT k, unnest(range(n)) AS i FROM p), e AS (SELECT k, i, unnest(range(i % 3 + 1)) AS j FROM l),
 m AS (SELECT CAST(k AS VARCHAR) AS map_id, i + 1 AS gen_line, i % 10 + 5 * j AS gen_column, j, i, 's' || ((i + 1) // 7) || '.js' AS source,
  row_number() OVER (PARTITION BY k ORDER BY i, j) + 1 AS orig_line, (k % 16) * (i + 1) AS orig_column,
  CASE WHEN j = 1 THEN 'n' || count(*) FILTER (j = 1) OVER (PARTITION BY k ORDER BY i, j) END AS name FROM e)"""


@query(f"{_MAPPINGS} SELECT map_id, gen_line, gen_column, source, orig_line, orig_column, name FROM m")
def vlq_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mappings(_maps(spark, sf_dir))


@query(f"""{_MAPPINGS}, w AS (SELECT map_id, source, CASE WHEN j = i % 3 THEN 4 ELSE 5 END AS bytes FROM m),
 u AS (SELECT CAST(k AS VARCHAR) AS map_id, i % 10 AS bytes FROM l), n AS (SELECT CAST(k AS VARCHAR) AS map_id, n - 1 AS bytes FROM p),
 r AS (SELECT map_id, 'source' AS kind, source AS path, sum(bytes) AS bytes FROM w GROUP BY ALL UNION ALL SELECT map_id, 'eol', '[EOL]', bytes FROM n UNION ALL SELECT map_id, 'unmapped', '[unmapped]', sum(bytes) FROM u GROUP BY ALL)
SELECT map_id, kind, path, CAST(bytes AS BIGINT) AS bytes FROM r WHERE bytes > 0""")  # fmt: skip
def bundle_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _maps(spark, sf_dir)
    return V.bundle_breakdown(V.mappings(maps), maps).select("map_id", "kind", "path", "bytes")


@query(f"{_MAPPINGS} SELECT map_id, source, count(*) AS mappings FROM m GROUP BY 1, 2")
def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mappings(_maps(spark, sf_dir)).groupBy("map_id", "source").agg(F.count("*").alias("mappings"))


@query(f"""{_MAPPINGS}, q AS (SELECT k AS ask_id, CAST(k AS VARCHAR) AS map_id, (k * 7) % n + 1 AS gen_line, k % 25 AS gen_column FROM p),
 c AS (SELECT q.ask_id, arg_max(struct_pack(source := source, orig_line := orig_line, orig_column := orig_column), m.gen_column) AS s FROM q JOIN m ON m.map_id = q.map_id AND m.gen_line = q.gen_line AND m.gen_column <= q.gen_column GROUP BY 1)
SELECT q.ask_id, c.s IS NOT NULL AS found, c.s.source AS source, c.s.orig_line AS orig_line, c.s.orig_column AS orig_column FROM q LEFT JOIN c USING (ask_id)""")  # fmt: skip
def lookup_generated_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = _parts(spark, sf_dir).selectExpr("k AS ask_id", "CAST(k AS STRING) AS map_id", "(k * 7) % n + 1 AS gen_line", "k % 25 AS gen_column")
    return V.lookup_generated(V.mappings(_maps(spark, sf_dir)), asks).select("ask_id", "found", "source", "orig_line", "orig_column")


@query(f"""{_MAPPINGS}, q AS (SELECT k AS ask_id, CAST(k AS VARCHAR) AS map_id, 's0.js' AS source, k % 20 AS orig_line, (k % 16) * (k % 3 + 1) AS orig_column FROM p)
SELECT q.ask_id, count(gen_line) AS places, min(gen_line) AS first_line FROM q LEFT JOIN m USING (map_id, source, orig_line, orig_column) GROUP BY 1""")  # fmt: skip
def lookup_original_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = _parts(spark, sf_dir).selectExpr("k AS ask_id", "CAST(k AS STRING) AS map_id", "'s0.js' AS source", "k % 20 AS orig_line", "(k % 16) * (k % 3 + 1) AS orig_column")
    found = V.lookup_original(V.mappings(_maps(spark, sf_dir)), asks)
    return found.select("ask_id", F.size("matches").cast("long").alias("places"), F.get("matches", F.lit(0))["gen_line"].alias("first_line"))


@query(f"WITH p AS ({_PARTS}) SELECT CAST(k AS VARCHAR) AS map_id, 61 AS names FROM p")
def name_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.name_counts(_maps(spark, sf_dir))


_TEXTS = {"content": "'{\"version\":3,\"sources\":[\"' || a || k || '.js\",\"' || b || '.js\"],\"sourcesContent\":[\"' || repeat(a, n) || '\"]}'"}


@query(_sql("SELECT CAST(k AS VARCHAR) AS map_id, a || k || '.js' AS source, n * length(a) AS size, false AS missing_content FROM f UNION ALL SELECT CAST(k AS VARCHAR), b || '.js', 0, true FROM f"))
def original_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _parts(spark, sf_dir, **_TEXTS)
    return V.original_files(maps, map_id="k").select("map_id", "source", "size", "missing_content")


_GUARDED = {
    "content": "CASE k % 5 WHEN 0 THEN '{\"version\":3,\"sources\":[\"' || a || '\"]}' WHEN 1 THEN ')]}' || chr(39) || chr(10) || '{\"version\":3,\"sections\":[]}' WHEN 2 THEN '{\"version\":2,\"sources\":[]}' WHEN 3 THEN '{\"version\":3}' ELSE a END"
}


@query(_sql("SELECT k, k % 5 < 2 AS valid, CASE k % 5 WHEN 2 THEN 'unsupported version' WHEN 3 THEN 'no sources' WHEN 4 THEN 'not a JSON object' END AS error FROM f"))
def validated_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validated_maps(_parts(spark, sf_dir, **_GUARDED)).select("k", "valid", "error")


_PACKAGED = {
    "path": "CASE k % 5 WHEN 0 THEN 'p' || k || '/package.json' WHEN 1 THEN 'a/node_modules/lib' || (k % 30) || '/index' || k || '.js' WHEN 2 THEN 'src/' || k || '.js' WHEN 3 THEN 'm' || k || '.js.map' ELSE 'plain' || k || '.txt' END",
    "content": "CASE k % 5 WHEN 0 THEN '{\"name\":\"app' || (k % 50) || '\",\"version\":\"1.' || (k % 7) || '.0\",\"dependencies\":{\"dep' || (k % 20) || '\":\"^' || n || '.0\"}}' WHEN 1 THEN 'x'"
    " WHEN 2 THEN 'import x from \"imp' || (k % 25) || '/fp' || (k % 3) || '\"; require(\"imp' || (k % 10) || '\"); import(\"./b\"); import \"fs\"'"
    " WHEN 3 THEN '{\"version\":3,\"sources\":[\"npm:vue' || (k % 15) || '@3.' || (k % 4) || '.1/index.js\",\"webpack:///./node_modules/lib' || (k % 30) || '/index.js\"]}' ELSE 'nothing' END",
}


@query(_sql("""SELECT name, version, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS confidence, imports, exact_files FROM (
 SELECT name, arg_max(version, priority || detail) FILTER (version IS NOT NULL) AS version, CAST(greatest(max(base), CASE WHEN count(DISTINCT spec) > 0 THEN least(48, 18 + 12 * count(DISTINCT spec)) ELSE 0 END) AS BIGINT) AS score,
  count(DISTINCT spec) AS imports, count(DISTINCT CASE WHEN kind = 'n' THEN k END) AS exact_files FROM (
 SELECT 'app' || (k % 50) AS name, '1.' || (k % 7) || '.0' AS version, 100 AS base, 5 AS priority, path AS detail, NULL AS spec, 'm' AS kind, k FROM f WHERE k % 5 = 0
 UNION ALL SELECT 'dep' || (k % 20), '^' || n || '.0', 55, 1, path, NULL, 'd', k FROM f WHERE k % 5 = 0
 UNION ALL SELECT 'lib' || (k % 30), NULL, 96, 4, path, NULL, 'n', k FROM f WHERE k % 5 = 1
 UNION ALL SELECT 'imp' || (k % 25), NULL, 0, 0, '', 'imp' || (k % 25) || '/fp' || (k % 3), 'i', k FROM f WHERE k % 5 = 2
 UNION ALL SELECT 'imp' || (k % 10), NULL, 0, 0, '', 'imp' || (k % 10), 'i', k FROM f WHERE k % 5 = 2
 UNION ALL SELECT 'vue' || (k % 15), '3.' || (k % 4) || '.1', 90, 3, 'npm:vue' || (k % 15) || '@3.' || (k % 4) || '.1/index.js', NULL, 'v', k FROM f WHERE k % 5 = 3
 UNION ALL SELECT 'lib' || (k % 30), NULL, 72, 2, '', NULL, 's', k FROM f WHERE k % 5 = 3) GROUP BY 1)""", **_PACKAGED))  # fmt: skip
def infer_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _parts(spark, sf_dir, **_PACKAGED).withColumn("file_id", F.col("k").cast("string")).withColumn("size", F.octet_length("content").cast("long"))
    return K.packages(K.evidence(files)).select("name", "version", "score", "confidence", "imports", "exact_files")


#: Bundles: an import and constants that are small, a function and exports that follow; every third file is empty.
_BUNDLE = {
    "file_id": "CAST(k AS VARCHAR(20))",
    "path": "CASE WHEN k < 4 THEN 'late' || k || '.js' ELSE 'main' || k || '.js' END",
    "content": "CASE WHEN k % 3 <> 2 THEN 'import { x } from \"./lib' || (k % 40) || '.js\";' || repeat(' ', 130) || chr(10) || 'const r' || k || ' = boot' || k || '(x), two = \"a;b\";' || repeat(' ', 130) || chr(10)"
    " || 'function boot' || k || '(q) { return import(\"./late' || (k % 9) || '.js\"); // ;' || chr(10) || '}' || repeat(' ', 130) || chr(10) || 'export { r' || k || ' as default, boot' || k || ' };' END",
}


@query(_sql("""SELECT CAST(k AS VARCHAR) AS file_id, s AS stmt, ['import', 'const', 'function', 'export'][s + 1] AS kind, CASE s WHEN 1 THEN 'r' || k || ',two' WHEN 2 THEN 'boot' || k ELSE '' END AS declares,
 CASE s WHEN 3 THEN 'default,boot' || k ELSE '' END AS exports, CASE s WHEN 0 THEN './lib' || (k % 40) || '.js' ELSE '' END AS imports, CASE s WHEN 2 THEN './late' || (k % 9) || '.js' ELSE '' END AS dynamic_imports
 FROM f, (VALUES (0), (1), (2), (3)) AS t(s) WHERE k % 3 <> 2"""))  # fmt: skip
def statement_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("declares", "exports", "imports", "dynamic_imports")
    found = M.statements(_parts(spark, sf_dir, **_BUNDLE), ("file_id", "stmt", "kind", *names))
    return found.selectExpr("file_id", "stmt", "kind", *[f"array_join({c}, ',') AS {c}" for c in names])


@query(_sql("SELECT CAST(k AS VARCHAR) AS file_id, s AS source, 1 - s AS target, 1 AS symbols FROM f, (VALUES (0), (1)) AS t(s) WHERE k % 3 <> 2"))
def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import and the constants are small and share module 0; the function and the export follow as 1."""
    return M.edges(M.statements(_parts(spark, sf_dir, **_BUNDLE), ("file_id", "declares", "uses", "module")))


@query(_sql("SELECT count(DISTINCT k) AS chunks, 2 * count(*) AS modules, round(avg((0.3 + 0.25 + 0.18 + 0.3 + 0.25 + 0.2) / 2), 6) AS average_score, 2 * count(*) AS edges FROM f WHERE k % 3 <> 2"))
def module_graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(M.statements(_parts(spark, sf_dir, **_BUNDLE)))
    return M.graph_summary(M.modules(rows), M.edges(rows))


@query(_sql("SELECT 'late' || (k % 9) || '.js' AS target, count(*) AS statements FROM f WHERE k % 3 <> 2 AND k % 9 > 3 GROUP BY 1"))
def missing_dynamic_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _parts(spark, sf_dir, **_BUNDLE)
    return M.missing_imports(M.statements(files, ("dynamic_imports",)), files)


#: Bundles whose modules are functions by number, in an object or an array, with their requires.
_PACK = {
    "file_id": "CAST(k AS VARCHAR(20))",
    "content": "CASE k % 3 WHEN 0 THEN '!function(e){var t={};function r(n){return e[n](t,r)}r(0)}([function(e,t,r){var a=r(100);e.exports=a},function(e,t){e.exports=\"' || a || '],{}\"}])'"
    " WHEN 1 THEN '(self.webpackChunk=self.webpackChunk||[]).push([[' || k || '],{' || (k + 1000) || ':(e,t,r)=>{\"use strict\";r.d(t,{' || a || ':()=>n,z:()=>m});const n=r(' || (k + 1001) || '),m=r(7)},' || (k + 1001)"
    " || ':function(e,t,n){/* n(99999) */e.exports=n(' || (k + 1000) || ')+n(' || (k + 1001) || ')},\"x/' || b || '\":function(e){e.exports={}}}])' ELSE 'const plain = {a: 1, b: [' || k || ']};' END",
}


@query(_sql("""SELECT file_id, module, requires, exports, score FROM (
 SELECT CAST(k AS VARCHAR) AS file_id, '0' AS module, '100' AS requires, '' AS exports, CAST(0.8 AS DOUBLE) AS score FROM f WHERE k % 3 = 0 UNION ALL SELECT CAST(k AS VARCHAR), '1', '', '', 0.76 FROM f WHERE k % 3 = 0
 UNION ALL SELECT CAST(k AS VARCHAR), CAST(k + 1000 AS VARCHAR), CAST(k + 1001 AS VARCHAR), a || ',z', 0.8 FROM f WHERE k % 3 = 1
 UNION ALL SELECT CAST(k AS VARCHAR), CAST(k + 1001 AS VARCHAR), (k + 1000) || ',' || (k + 1001), '', 0.8 FROM f WHERE k % 3 = 1
 UNION ALL SELECT CAST(k AS VARCHAR), 'x/' || b, '', '', 0.76 FROM f WHERE k % 3 = 1)""", **_PACK))  # fmt: skip
def webpack_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = W.modules(_parts(spark, sf_dir, **_PACK))
    return found.selectExpr("file_id", "module", "array_join(requires, ',') AS requires", "array_join(exports, ',') AS exports", "score")


@query(_sql("""SELECT CAST(k AS VARCHAR) AS file_id, CAST(k + 1000 + s AS VARCHAR) AS source, CAST(k + 1001 - s AS VARCHAR) AS target FROM f, (VALUES (0), (1)) AS t(s) WHERE k % 3 = 1"""))
def webpack_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.edges(W.modules(_parts(spark, sf_dir, **_PACK)))


#: Files of n lines in which every tenth line declares something.
_LINES = {"file_id": "CAST(k AS VARCHAR(20))"}


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i % 10 == 9, F.concat(F.lit("function f"), i.cast("string"), F.lit("() {}"))).otherwise(F.lit("  x();")))
    return _parts(spark, sf_dir, **_LINES).withColumn("content", F.array_join(body, "\n"))


@query(f"""WITH p AS ({_PARTS}), l AS (SELECT CAST(k AS VARCHAR) AS file_id, unnest(range(n)) AS i FROM p)
SELECT file_id, i // 8 AS fragment, min(i) + 1 AS first_line, max(i) + 1 AS last_line, CAST(sum(CASE WHEN i % 10 = 9 THEN length('function f() {{}}' || i) ELSE 6 END + 1) AS BIGINT) AS bytes FROM l GROUP BY 1, 2""")
def line_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.fragments(_lined(spark, sf_dir), 8)


@query(f"""WITH p AS ({_PARTS}), l AS (SELECT CAST(k AS VARCHAR) AS file_id, unnest(range(n)) AS i FROM p)
SELECT file_id, (i + 1) // 10 AS section, min(i) + 1 AS first_line, count(*) AS lines FROM l GROUP BY 1, 2""")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sections(_lined(spark, sf_dir), "^function ")


_SIGNS = {
    "file_id": "CAST(k AS VARCHAR(20))",
    "path": "CASE k % 4 WHEN 0 THEN 'x/' || a || '.worker.js' ELSE a || k || '.js' END",
    "content": "CASE k % 4 WHEN 0 THEN 'self.onmessage = 1; postMessage(' || k || '); importScripts(' || k || ')' WHEN 1 THEN 'new WebGLRenderer(); Object3D' WHEN 2 THEN 'createRoot(' || a || ')' ELSE a END",
}


@query(_sql("""SELECT CAST(k AS VARCHAR) AS file_id, 'worker-runtime' AS id, 4 AS evidence, CAST(0.95 AS DOUBLE) AS confidence FROM f WHERE k % 4 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'three-runtime', 2, 0.77 FROM f WHERE k % 4 = 1"""))
def runtime_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.signals(_parts(spark, sf_dir, **_SIGNS)).select("file_id", "id", F.size("evidence").alias("evidence"), "confidence")


@query(_sql("SELECT CAST(k AS VARCHAR) AS file_id, CASE k % 4 WHEN 1 THEN 'three' ELSE 'react-dom' END AS id FROM f WHERE k % 4 IN (1, 2)"))
def dependency_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.signals(_parts(spark, sf_dir, **_SIGNS), R.DEPENDENCIES).select("file_id", "id")


_NAMES = {"name": "a || upper(substr(b, 1, 1)) || substr(b, 2) || '_' || a || '-' || k", "block": "'export { ' || a || ' as ' || b || ', c' || k || ' };'", "code": "'x(' || chr(39) || repeat(a, n) || chr(39) || ', \"q\")'", "headers": "'Content-Type: ' || a || chr(10) || 'bad' || chr(10) || 'x-n : ' || n"}


@query(_sql("""SELECT k, a || ',' || b || ',' || a || ',' || k AS words, a || upper(substr(b, 1, 1)) || substr(b, 2) || upper(substr(a, 1, 1)) || substr(a, 2) || k AS camel, a || ':' || b || ',c' || k || ':c' || k AS exports,
 CASE WHEN n * length(a) + 2 >= 100 THEN 1 ELSE 0 END AS literals, '{"content-type":"' || a || '","x-n":"' || n || '"}' AS headers, 'file-' || k AS relative, 2 AS found FROM f"""))  # fmt: skip
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    aliases = F.array_join(F.transform(X.export_aliases(c("block")), lambda p: F.concat(p["local"], F.lit(":"), p["exported"])), ",")
    rows = _parts(spark, sf_dir, **_NAMES)
    return rows.select(
        "k", F.array_join(X.split_words(c("name")), ",").alias("words"), X.camel_case(c("name")).alias("camel"), aliases.alias("exports"), F.size(X.large_literals(c("code"), 100)).alias("literals"),
        F.to_json(X.header_lines(c("headers"))).alias("headers"), P.basename(F.concat(F.lit("src/file-"), c("k"), F.lit(".js"))).alias("relative"), X.occurrences(F.concat(c("a"), F.lit("|"), c("a")), c("a")).alias("found"),
    )


_MOVED = {"source": "CASE k % 4 WHEN 0 THEN 'pages/' || a || '/p' || k || '.js' WHEN 1 THEN 'dist/' || b || k || '.css' WHEN 2 THEN 'own/x' || k ELSE 'package.json' END"}


@query(_sql("""SELECT k, CASE k % 4 WHEN 0 THEN '../../lib/' || a WHEN 3 THEN './lib/' || a ELSE '../lib/' || a END AS specifier, CASE k % 4 WHEN 1 THEN '/*' WHEN 3 THEN '{' ELSE '//' END AS placeholder,
 CASE k % 4 WHEN 0 THEN 'pages/' || a || '/p' || k || '.js' WHEN 1 THEN 'recovered/dist/' || b || k || '.css' WHEN 2 THEN 'src/own/x' || k || '.js' ELSE 'recovered/package' || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.json' END AS output
 FROM (SELECT f.* EXCLUDE n, row_number() OVER (PARTITION BY k % 4 ORDER BY k) AS n FROM f)""", **_MOVED))  # fmt: skip
def rebuilt_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_MOVED)
    # Files of one path are told apart by their number here, so that the SQL can follow.
    rows = rows.withColumn("source", F.when(F.col("source") != "package.json", F.col("source")).otherwise(F.concat("source", F.lit("#"), F.lpad(F.col("k").cast("string"), 9, "0"))))
    plain = F.substring_index("source", "#", 1)
    placed = resolve.output_paths(rows.withColumn("path", plain).withColumn("source", F.col("source")), "path", "source")
    holder = F.regexp_extract(resolve.placeholder(plain), r"^(/\*|//|\{)", 1)
    return placed.select("k", resolve.relative_specifier(plain, F.concat(F.lit("lib/"), F.col("a"))).alias("specifier"), holder.alias("placeholder"), "output")


_HINTED = {"required": "CASE k % 4 WHEN 0 THEN 'require_react' WHEN 1 THEN 'require_typeof' || k WHEN 2 THEN 'require_shim' ELSE 'require_react' || k END", "export": "CASE k % 4 WHEN 0 THEN 'useNavigate' WHEN 1 THEN 'Mesh' || k || 'Store' WHEN 2 THEN 'SOLVER' || k ELSE 'plain' || k END"}


@query(_sql("SELECT k, CASE k % 4 WHEN 0 THEN 'react' WHEN 1 THEN 'oxc-runtime-helpers' WHEN 2 THEN 'sync-external-store' END AS vendor, CASE k % 4 WHEN 0 THEN 'routing' WHEN 1 THEN 'three-rendering,state' WHEN 2 THEN 'cad-kernel' ELSE '' END AS hints FROM f"))
def vendor_and_export_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_HINTED)
    return rows.select("k", scoring.vendor_of(F.col("required")).alias("vendor"), F.array_join(X.export_hints(F.array("export", F.lit(""))), ",").alias("hints"))


@query(f"""WITH RECURSIVE p AS ({_PARTS}), l AS (SELECT k, unnest(range(n)) AS i FROM p), s AS (SELECT k, i, 0 AS part, 1 AS held FROM l WHERE i = 0
 UNION ALL SELECT s.k, l.i, CASE WHEN l.i % 10 = 9 AND s.held >= 12 THEN s.part + 1 ELSE s.part END, CASE WHEN l.i % 10 = 9 AND s.held >= 12 THEN 1 ELSE s.held + 1 END FROM s JOIN l ON l.k = s.k AND l.i = s.i + 1)
SELECT CAST(k AS VARCHAR) AS file_id, part, min(i) + 1 AS first_line, max(i) + 1 AS last_line FROM s GROUP BY 1, 2""")
def declaration_sub_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before a declaration close a block here, so every tenth line can be cut at."""
    files = _lined(spark, sf_dir).withColumn("content", F.replace("content", F.lit("  x();"), F.lit("}")))
    return L.sub_sections(files, "^function ", 12)


@query(f"""WITH RECURSIVE p AS ({_PARTS}), l AS (SELECT k, i, CASE WHEN i % 10 = 9 THEN length('function f() {{}}' || i) ELSE 6 END + 1 AS size FROM (SELECT k, unnest(range(n)) AS i FROM p)),
 s AS (SELECT k, i, 0 AS part, 1 AS held, size AS bytes FROM l WHERE i = 0 UNION ALL SELECT s.k, l.i, CASE WHEN held >= 15 OR bytes + l.size > 90 THEN part + 1 ELSE part END,
 CASE WHEN held >= 15 OR bytes + l.size > 90 THEN 1 ELSE held + 1 END, CASE WHEN held >= 15 OR bytes + l.size > 90 THEN l.size ELSE bytes + l.size END FROM s JOIN l ON l.k = s.k AND l.i = s.i + 1)
SELECT CAST(k AS VARCHAR) AS file_id, part, min(i) + 1 AS first_line, max(i) + 1 AS last_line FROM s GROUP BY 1, 2""")  # fmt: skip
def fallback_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bounded_fragments(_lined(spark, sf_dir), 15, 90)
