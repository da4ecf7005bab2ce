"""Predicates, references, orders and sinks over files made from the ``part`` table; see generated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.durable import shared_folder
from sitelens.functions import html as H
from sitelens.functions import paths as P
from sitelens.functions import predicates as Q
from sitelens.functions import text as X
from sitelens.operators import findings as D
from sitelens.operators import fingerprints as R
from sitelens.operators import iife as I
from sitelens.operators import lines as L
from sitelens.operators import planning as N
from sitelens.operators import scoring
from sitelens.operators import webpack as W
from sitelens.plans.generated import _PACK, _parts, _sql
from sitelens.registry import query, table
from sitelens.sources import exports as E
from sitelens.sources import files as S
from sitelens.sources import resolve
from sitelens.streaming import state as T

_FILE = {
    "path": "CASE k % 10 WHEN 0 THEN 'src/' || a || k || '.js' WHEN 1 THEN 'node_modules/' || b || '/i.js' WHEN 2 THEN 'webpack/boot' || k || '.js' WHEN 3 THEN '../' || a || '.css' WHEN 4 THEN 'a/../../' || b WHEN 5 THEN a || '/_manifest.json'"
    " WHEN 6 THEN a || '/vendor-' || k || '.js' WHEN 7 THEN '/etc/' || b WHEN 8 THEN a || '/x' || k || '.js.map' ELSE a || '/worker/' || k || '.TXT' END",
    "size": "n * 200000",
}


@query(_sql("""SELECT k, k % 10 = 1 AS third_party, k % 10 = 2 AS runtime_helper, k % 10 IN (5, 8) AS metadata, k % 10 IN (6, 9) AS runtime, k % 10 NOT IN (3, 4, 7) AS inside,
 CASE WHEN n * 200000 > 5242880 THEN 'preserve' WHEN k % 2 = 0 AND n * 200000 >= 307200 THEN 'preserve' WHEN n * 200000 >= 307200 THEN 'risk' ELSE 'transform' END AS gate,
 CASE WHEN k % 7 = 0 THEN 'excluded' WHEN k % 5 = 0 THEN 'unreadable' WHEN k % 10 IN (0, 1, 2, 3, 6) THEN 'transform' ELSE 'passthrough' END AS status, contains(a || ' ' || b, 'red') AS found FROM f""", **_FILE))  # fmt: skip
def file_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("path"), F.col("k")
    return _parts(spark, sf_dir, **_FILE).select(
        "k", Q.third_party(c).alias("third_party"), Q.runtime_helper(c).alias("runtime_helper"), Q.generated_metadata(c).alias("metadata"), Q.runtime_path(c).alias("runtime"), Q.inside_root(c).alias("inside"),
        Q.size_gate(F.col("size"), k % 2 == 0).alias("gate"), Q.transform_status(c, k % 5 != 0, k % 7 == 0).alias("status"), Q.search("RED", F.col("a"), F.col("b")).alias("found"),
    )


@query(_sql("SELECT k, path FROM f WHERE k % 10 NOT IN (1, 2)", **_FILE))
def own_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.own_files(_parts(spark, sf_dir, **_FILE)).select("k", "path")


@query(_sql("SELECT k, path FROM f WHERE k % 10 IN (0, 1, 2, 3, 5, 6)", **_FILE))
def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bundle_files(_parts(spark, sf_dir, **_FILE)).select("k", "path")


_SECRET = {
    "value": "CASE k % 10 WHEN 0 THEN '9f8e7d6c' || k WHEN 1 THEN a || upper(b) || 'abcdefgh' WHEN 2 THEN 'MY_CONST_' || upper(a) WHEN 3 THEN 'my_' || a || '_api_key' WHEN 4 THEN 'menu_group_' || a WHEN 5 THEN CAST(k + 100000000 AS VARCHAR(20))"
    " WHEN 6 THEN 'include' || a || '_9__' WHEN 7 THEN 'x_1__y' || k || 'zzz' WHEN 8 THEN '_' || a || 'abcdefg' || k ELSE 'abc' || (k % 10) END"
}


@query(_sql("SELECT k, value, k % 10 NOT IN (0, 3, 7) AS unlikely FROM f", **_SECRET))
def secret_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, **_SECRET).select("k", "value", D.unlikely_secret(F.col("value")).alias("unlikely"))


_HINT = {"hint": "CASE k % 7 WHEN 0 THEN a || '-lib' || k WHEN 1 THEN 'abc' WHEN 2 THEN './' || a WHEN 3 THEN n || 'px' WHEN 4 THEN 'button' WHEN 5 THEN '@s' || a || '/' || b ELSE 'Has Space' END"}


@query(_sql("SELECT k, k % 7 IN (0, 5) AS hint FROM f"))
def package_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, **_HINT).select("k", Q.package_hint(F.col("hint")).alias("hint"))


_FORM = {
    "code": "a || '  ' || chr(13) || chr(10) || b || chr(9) || chr(10) || chr(10)",
    "tagged": "'<' || a || ' b=\"' || b || '\">&' || chr(39)",
    "word": "CASE k % 4 WHEN 0 THEN substr(a, 1, 1) WHEN 1 THEN substr(a, 1, 1) || k WHEN 2 THEN a || '_' || k ELSE k || a END",
    "body": "CASE k % 4 WHEN 0 THEN 'e.preventDefault()' WHEN 1 THEN 'e.map(x)' WHEN 2 THEN 'e(1)' ELSE 'f.message' END",
}


@query(_sql("""SELECT k, a || chr(10) || b || chr(10) AS normalized, chr(13) || chr(10) AS ending, '&lt;' || a || ' b=&quot;' || b || '&quot;&gt;&amp;&#39;' AS escaped, k % 4 <> 3 AS identifier, k % 4 < 2 AS minified,
 CASE k % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'items' WHEN 2 THEN 'callback' END AS parameter, upper(substr(a, 1, 1)) || substr(a, 2) || ' ' || upper(substr(b, 1, 1)) || substr(b, 2) AS title,
 CASE WHEN n * 100 < 1024 THEN (n * 100) || ' B' ELSE printf('%.1f KB', round(n * 100 / 1024.0, 1)) END AS size FROM f"""))  # fmt: skip
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _parts(spark, sf_dir, **_FORM).select(
        "k", X.normalized_code(c("code")).alias("normalized"), X.line_ending(c("code")).alias("ending"), X.html_escaped(c("tagged")).alias("escaped"), X.is_identifier(c("word")).alias("identifier"),
        X.is_minified(c("word")).alias("minified"), X.parameter_name(c("body"), F.lit("e")).alias("parameter"), X.title_case(F.concat_ws("_", "a", "b")).alias("title"), P.byte_size(c("n") * 100).alias("size"),
    )


@query(_sql("SELECT k, CASE k % 3 WHEN 0 THEN '{\"a\":\"' || a || ' é\"}' WHEN 1 THEN a || ' b+' || n END AS text FROM f"))
def data_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    packed = F.concat(F.lit("data:application/json;base64,"), F.base64(F.concat(F.lit('{"a":"'), "a", F.lit(' é"}')).cast("binary")))
    url = F.when(F.col("k") % 3 == 0, packed).when(F.col("k") % 3 == 1, F.concat(F.lit("data:,"), "a", F.lit("%20b+"), F.col("n").cast("string"))).otherwise(F.concat("a", F.lit(".map")))
    return rows.select("k", S.data_url_text(url).alias("text"))


#: Scripts that name their map by path, by a name that only another folder has, by address, or wrongly; every third map is there.
_REFERRING = {
    "path": "'js/' || a || '/s' || k || '.js'",
    "reference": "CASE k % 5 WHEN 0 THEN 's' || k || '.js.map' WHEN 1 THEN '../../x/only' || k || '.map?v=1' WHEN 2 THEN 'https://h.org/' || a || '.map' WHEN 3 THEN 'gone' || k || '.map' END",
}


@query(_sql("""SELECT k, CASE k % 5 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN 'path' ELSE 'missing' END WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'basename' ELSE 'missing' END WHEN 2 THEN 'absolute' ELSE 'missing' END AS how,
 CASE k % 5 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN path || '.map' END WHEN 1 THEN CASE WHEN k % 3 = 0 THEN 'maps/only' || k || '.map' END WHEN 2 THEN reference END AS resolved FROM f WHERE k % 5 <> 4""", **_REFERRING))  # fmt: skip
def map_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = _parts(spark, sf_dir, **_REFERRING).select("k", "path", "reference")
    there = scripts.filter("k % 3 = 0").selectExpr("CAST(NULL AS BIGINT) AS k", "CASE k % 5 WHEN 0 THEN path || '.map' ELSE 'maps/only' || k || '.map' END AS path", "CAST(NULL AS STRING) AS reference", "k % 5 AS m")
    files = scripts.unionByName(there.filter("m < 2").drop("m"))
    return resolve.resolved_references(files).select("k", "how", "resolved")


@query(_sql("SELECT k, CASE k % 3 WHEN 0 THEN 'h' || k || '.map' WHEN 1 THEN 'x' || k || '.map' ELSE 'c' || k || '.map' END AS reference FROM f"))
def header_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, header="CASE k % 3 WHEN 0 THEN 'SourceMap: h' || k || '.map' WHEN 1 THEN 'X-SourceMap: x' || k || '.map' ELSE 'Server: ' || a END", content="'x' || chr(10) || '//# sourceMappingURL=c' || k || '.map'")
    return rows.select("k", resolve.map_reference(X.header_lines(F.col("header")), F.col("content")).alias("reference"))


@query(_sql("SELECT k, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'body ' || k WHEN k % 2 = 1 THEN 'own ' || a END AS content, k % 2 = 0 AND k % 3 <> 0 AS missing_content FROM f"))
def fetched_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, path="'https://h.org/' || k || '.js'", content="CASE WHEN k % 2 = 1 THEN 'own ' || a END", missing_content="k % 2 = 0")
    fetched = rows.filter("k % 3 = 0").selectExpr("path AS url", "'body ' || k AS body")
    return resolve.with_fetched_content(rows, fetched).select("k", "content", "missing_content")


@query(_sql("SELECT 'm/' || k AS chunk, 'p' || s || '.js' AS file, n + s AS lines, CASE WHEN s = 1 THEN 'text ' || k END AS part_content FROM f, (VALUES (1), (2)) AS t(s)"))
def split_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, path="'m/' || k || '/_manifest.json'", content="'{\"parts\":[{\"file\":\"p1.js\",\"lines\":' || (n + 1) || '},{\"file\":\"p2.js\",\"lines\":' || (n + 2) || '}]}'")
    texts = rows.selectExpr("'m/' || k || '/p1.js' AS path", "'text ' || k AS content")
    return resolve.manifest_parts(rows, texts).select("chunk", "file", "lines", "part_content")


@query(_sql("SELECT k, k % 2 = 0 AS valid FROM f"))
def wasm_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("k") % 2 == 0, F.lit(b"\0asm")).otherwise(F.lit(b"<htm"))
    return _parts(spark, sf_dir).select("k", S.valid_wasm(F.concat(head, F.col("a").cast("binary"))).alias("valid"))


_PLACED = {"path": "CASE k % 3 WHEN 0 THEN 'root/' || a || '/' || b || '/' || k || '.js' ELSE 'root/' || a || '/x/' || k || '.js' END"}


@query(_sql("SELECT a, CASE WHEN count(DISTINCT CASE k % 3 WHEN 0 THEN b ELSE 'x' END) = 1 THEN 'root/' || a || '/' || min(CASE k % 3 WHEN 0 THEN b ELSE 'x' END) ELSE 'root/' || a END AS prefix FROM f GROUP BY a"))
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.common_prefix(_parts(spark, sf_dir, **_PLACED), ["a"], "path")


@query("""WITH t AS (SELECT user_id, event_id, 1 + event_id % 40 AS size FROM events), w AS (SELECT *, max(CASE WHEN size >= 20 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS anchor FROM t)
SELECT user_id, min(event_id) AS event_id, CAST(sum(size) AS BIGINT) AS size, count(*) AS groups FROM w GROUP BY user_id, anchor""")  # fmt: skip
def merged_tiny_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "1 + event_id % 40 AS size")
    return L.merge_tiny(rows, ["user_id"], "event_id", "size", F.col("size") < 20)


_PLAN = {
    "confidence": "CAST(n AS DOUBLE) / 50", "risk": "CASE k % 4 WHEN 0 THEN 'high' ELSE 'low' END", "scope": "CASE k % 5 WHEN 0 THEN 'recovered' ELSE 'own' END", "file": "a || '/' || k || '.js'",
    "readiness": "CAST(k % 21 AS DOUBLE) / 20", "lines": "n * 37", "fragment": "CASE k % 3 WHEN 0 THEN 1 ELSE 0 END",
}


@query(_sql("SELECT k, file, confidence FROM f WHERE n >= 35 AND k % 4 <> 0 AND k % 5 <> 0 ORDER BY confidence DESC, file LIMIT 80", **_PLAN))
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-risk rows of enough confidence, the first 80 by confidence, then file."""
    rows = Q.apply_gate(_parts(spark, sf_dir, **_PLAN), 0.7, 80, [F.desc("confidence"), F.col("file")])
    return rows.select("k", "file", "confidence")


@query(_sql("SELECT k, rank FROM (SELECT k, row_number() OVER (ORDER BY readiness DESC, fragment, lines, file) AS rank FROM f) WHERE rank <= 50", **_PLAN))
def extraction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness first, whole parts before fragments, short ones before long ones: the first 50 with their rank."""
    rows = _parts(spark, sf_dir, **_PLAN).withColumn("all", F.lit(0)).orderBy(F.desc("readiness"), "fragment", "lines", "file").limit(50)
    rank = scoring.Window.partitionBy("all").orderBy(F.desc("readiness"), "fragment", "lines", "file")
    return rows.select("k", F.row_number().over(rank).alias("rank"))


@query(_sql("SELECT k, readiness * 1000000 + lines AS action FROM f ORDER BY readiness * 1000000 + lines, file LIMIT 30", **_PLAN))
def actionability_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.col("readiness") * 1_000_000 + F.col("lines")
    return _parts(spark, sf_dir, **_PLAN).select("k", "file", action.alias("action")).orderBy("action", "file").limit(30).select("k", "action")


@query(_sql("""SELECT a, arg_min(path, (path <> 'package.json', length(path), path)) AS path FROM (SELECT a, CASE WHEN k % 97 = 0 THEN 'package.json' ELSE b || repeat('/x', n) || '/package.json' END AS path FROM f) GROUP BY a"""))
def manifest_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest at the root, else the one of the shortest path."""
    rows = _parts(spark, sf_dir, path="CASE WHEN k % 97 = 0 THEN 'package.json' ELSE b || repeat('/x', n) || '/package.json' END")
    return scoring.first_by(rows, ["a"], [F.col("path") != "package.json", F.length("path"), F.col("path")]).select("a", "path")


@query(_sql("SELECT b, arg_min(k, (CASE k % 5 WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END, k)) AS k FROM f GROUP BY b"))
def entrypoint_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a list of names that a group has, else its first file."""
    order = F.coalesce(F.nullif(F.array_position(F.array(F.lit("main"), F.lit("index")), F.col("name")), F.lit(0)), F.lit(9))
    rows = _parts(spark, sf_dir, name="CASE k % 5 WHEN 3 THEN 'main' WHEN 1 THEN 'index' ELSE a END")
    return scoring.first_by(rows, ["b"], [order, F.col("k")]).select("b", "k")


@query(_sql("SELECT k, alias FROM (SELECT k, a || k AS alias, row_number() OVER (PARTITION BY b ORDER BY length(a || k), n DESC, k) AS r FROM f) WHERE r <= 40"))
def alias_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names first, then the most used, then the first: 40 of each group."""
    rows = _parts(spark, sf_dir, alias="a || k")
    return scoring.first_by(rows, ["b"], [F.length("alias"), F.desc("n"), F.col("k")], 40).select("k", "alias")


_TYPED = {"content": "CASE k % 4 WHEN 0 THEN 'import x from ' || a WHEN 1 THEN 'module.exports = ' || k WHEN 2 THEN 'require(' || k || ')' ELSE 'plain' END"}


@query(_sql("SELECT count(*) FILTER (k % 4 = 0) AS module, count(*) FILTER (k % 4 IN (1, 2)) AS commonjs, CASE WHEN count(*) FILTER (k % 4 IN (1, 2)) > count(*) FILTER (k % 4 = 0) THEN 'commonjs' ELSE 'module' END AS type FROM f"))
def module_type_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.module_type(_parts(spark, sf_dir, **_TYPED))


@query(_sql("""SELECT CAST(k AS VARCHAR) AS file_id, CASE k % 4 WHEN 0 THEN 'worker-runtime' ELSE 'three-runtime' END AS id FROM f WHERE k % 4 < 2"""))
def primary_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a worker that shows one sign of rendering as well, the runtime with more evidence."""
    made = {"file_id": "CAST(k AS VARCHAR(20))", "path": "a || k || '.js'", "content": "CASE k % 4 WHEN 0 THEN 'self.onmessage = 1; postMessage(' || k || '); Raycaster' WHEN 1 THEN 'BufferGeometry' ELSE a END"}
    return R.primary_signal(R.signals(_parts(spark, sf_dir, **made))).select("file_id", "id")


@query(_sql("SELECT CAST(k AS VARCHAR) AS file_id, CAST(k + 1000 + s AS VARCHAR) AS module, 1 AS importers FROM f, (VALUES (0), (1)) AS t(s) WHERE k % 3 = 1"))
def module_importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.importers(W.modules(_parts(spark, sf_dir, **_PACK)))


_KINDS = {"path": "CASE k % 4 WHEN 0 THEN a || '/server/' || k || '.ts' WHEN 1 THEN a || '/index.html' WHEN 2 THEN a || '/x.tsx' ELSE a || '/y.css' END"}


@query(_sql("""SELECT a, bool_or(k % 4 = 2) AS has_jsx, bool_or(k % 4 = 1) AS has_html, bool_or(k % 4 = 0) AS has_server, count(*) FILTER (k % 4 IN (0, 2)) AS typed FROM f GROUP BY a"""))
def project_kind_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("path")
    rows = _parts(spark, sf_dir, **_KINDS)
    return rows.groupBy("a").agg(
        F.bool_or(P.has_extension(c, "jsx", "tsx")).alias("has_jsx"), F.bool_or(P.has_extension(c, "html", "htm")).alias("has_html"), F.bool_or(c.contains("/server/")).alias("has_server"), F.count_if(P.has_extension(c, "ts", "tsx")).alias("typed")
    )


@query("""WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY 1)
SELECT count(*) AS jobs, count(*) FILTER (last IN ('error', 'purchase')) AS finished, count(*) = count(*) FILTER (last IN ('error', 'purchase')) AS complete FROM s""")  # fmt: skip
def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sitelens.plans.site import job_messages

    return T.batch_complete(T.latest_state(job_messages(table(spark, sf_dir, "events"))))


@query(_sql("SELECT a, string_agg(DISTINCT b, ',' ORDER BY b) AS words, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT n) AS sizes FROM f GROUP BY a"))
def merged_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lists flattened, merged by name and kept once."""
    nested = _parts(spark, sf_dir).groupBy("a", "n").agg(F.collect_set("b").alias("bs"), F.sum("n").alias("s"))
    merged = nested.groupBy("a").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bs")))).alias("words"), F.sum("s").alias("total"), F.count("*").alias("sizes"))
    return merged.select("a", F.array_join("words", ",").alias("words"), "total", "sizes")


@query(_sql("SELECT k, a || ', ' || b AS words, '{\"n\":' || n || '}' AS nested FROM f"))
def exported_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as tab-separated text with a header, read back."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    E.export_tsv(_parts(spark, sf_dir).select("k", F.array("a", "b").alias("words"), F.struct("n").alias("nested")), folder)
    return spark.read.option("sep", "\t").option("header", "true").option("escape", "\\").schema("k long, words string, nested string").csv(folder)


@query(_sql("SELECT k, a, n FROM f"))
def exported_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    E.export_json(_parts(spark, sf_dir).select("k", "a", "n"), folder)
    return spark.read.schema("k long, a string, n int").json(folder)


@query(_sql("SELECT k, CASE k % 3 WHEN 0 THEN 'text ' || a WHEN 1 THEN 'made ' || k ELSE '' END AS content FROM f"))
def rebuilt_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path is the part's key here."""
    rows = _parts(spark, sf_dir, path="CAST(k AS VARCHAR(20))", source_id="CASE WHEN k % 3 = 0 THEN 's' || k END", generated="CASE WHEN k % 3 = 1 THEN 'made ' || k END")
    sources = rows.filter("k % 3 = 0").selectExpr("'s' || k AS file_id", "'text ' || a AS content")
    return E.package_tree(rows, sources).select(F.col("path").cast("long").alias("k"), "content")


@query(_sql("SELECT 'c' || (k % 20) AS chunk, 'p' || k || '.js' AS file, length(a) + 1 + length(b) AS bytes, 2 AS lines FROM f"))
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).selectExpr("'c' || (k % 20) AS chunk", "'p' || k || '.js' AS file", "a || chr(10) || b AS content")
    return E.write_parts(rows, f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}")


@query("""WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 2 HOURS, ts) - INTERVAL 4 HOURS, time_bucket(INTERVAL 2 HOURS, ts), INTERVAL 2 HOURS)) AS start, event_type FROM events)
SELECT CAST(epoch(start) AS BIGINT) AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")  # fmt: skip
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours every two hours."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("at", "6 hours", "2 hours"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.unix_seconds("window.start").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, session""")  # fmt: skip
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.session_window("at", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


#: One big call: three constants, a class and its alias, a function, a component with a helper, an end.
_CALLED = {
    "file_id": "CAST(k AS VARCHAR(20))",
    "content": "'(function(){' || chr(10) || 'var v0 = 0;' || chr(10) || 'var v1 = \"a;{b\";' || chr(10) || 'var v2 = 2;' || chr(10) || 'class ' || upper(substr(a, 1, 1)) || k || ' {' || repeat(chr(10) || '  m() {}', 10 + k % 5) || chr(10) || '}' || chr(10)"
    " || 'var B = ' || upper(substr(a, 1, 1)) || k || ';' || chr(10) || 'function f' || k || '() {' || repeat(chr(10) || '  x();', 15 + k % 7) || chr(10) || '}' || chr(10) || 'function Card() {' || repeat(chr(10) || '  y();', 10) || chr(10) || '}' || chr(10)"
    " || 'const help = 1;' || chr(10) || 'return 1;' || chr(10) || '})();'",
}


@query(_sql("""SELECT CAST(k AS VARCHAR) AS file_id, s AS section, ['var', 'class', 'function', 'component'][s + 1] AS category, [3, 2, 1, 3][s + 1] AS statements,
 CASE s WHEN 0 THEN 3 WHEN 1 THEN 13 + k % 5 WHEN 2 THEN 17 + k % 7 ELSE 14 END AS lines, CASE s WHEN 0 THEN 'v0,v1,v2' WHEN 1 THEN 'B' WHEN 2 THEN 'f' || k ELSE 'Card,help' END AS names
 FROM f, (VALUES (0), (1), (2), (3)) AS t(s)"""))  # fmt: skip
def called_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.sections(_parts(spark, sf_dir, **_CALLED))
    own = F.filter("names", lambda n: ~n.rlike(r"^[A-Z]\d+\z"))  # the class goes by its part
    return found.select("file_id", "section", "category", "statements", "lines", F.array_join(own, ",").alias("names"))


_READY = {
    "file": "CASE k % 6 WHEN 0 THEN 'x/exports.js' WHEN 1 THEN 'a/state-' || k || '.js' ELSE a || k || '.js' END",
    "lines": "n * 200", "semantic": "k % 2 = 0", "fragment": "k % 7 = 0", "runnable": "CASE k % 3 WHEN 0 THEN CAST(NULL AS BOOLEAN) WHEN 1 THEN true ELSE false END", "candidate": "k % 5 = 0",
    "declarations": "k % 4", "exports": "k % 40", "runtime": "CASE k % 11 WHEN 0 THEN 'render-runtime' WHEN 1 THEN 'wasm-runtime' END", "embedded": "k % 13 = 0",
}


@query(_sql("""SELECT k, readiness, CASE WHEN readiness >= 0.72 THEN 'source-like' WHEN readiness >= 0.52 THEN 'review-needed' ELSE 'preserve-first' END AS label FROM (
 SELECT k, round(greatest(0.05, least(0.95, CAST(0.2 AS DOUBLE) + CASE WHEN k % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN k % 7 <> 0 THEN 0.18 ELSE 0 END + CASE WHEN k % 3 <> 2 THEN 0.08 ELSE 0 END
 + CASE WHEN n * 200 < 1500 THEN 0.12 WHEN n * 200 < 6000 THEN 0.08 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 0.08 ELSE 0 END + CASE WHEN k % 4 > 0 THEN 0.06 ELSE 0 END + CASE WHEN k % 6 < 2 THEN 0.1 ELSE 0 END
 + least(0.12, (k % 40) / 100.0) - CASE k % 11 WHEN 0 THEN 0.04 WHEN 1 THEN 0.14 ELSE 0 END - CASE WHEN k % 13 = 0 THEN 0.12 ELSE 0 END)), 6) AS readiness FROM p)"""))  # fmt: skip
def part_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.readiness(_parts(spark, sf_dir, **_READY)).select("k", "readiness", "label")


_PROMOTED = {
    "file": "CASE k % 9 WHEN 0 THEN 'c/exports.js' ELSE 'c/' || a || k || '.js' END", "lines": "CASE k % 10 WHEN 0 THEN n * 90 ELSE n END",
    "kind": "CASE k % 5 WHEN 0 THEN 'source-candidate' WHEN 1 THEN 'wrapper-candidate' WHEN 2 THEN 'runtime-wrapper' WHEN 3 THEN 'inspection-only' END",
    "exports": "k % 4", "declarations": "k % 17", "imports": "k % 8", "globals": "CASE k % 3 WHEN 0 THEN k % 5 END", "externals": "CASE k % 2 WHEN 0 THEN k % 16 ELSE 0 END", "runtimes": "CASE k % 7 WHEN 0 THEN 2 ELSE 0 END",
}


@query(_sql("""SELECT k, score, CASE WHEN bridge THEN CASE WHEN kind = 'runtime-wrapper' THEN 'create-runtime-export-facade' ELSE 'create-export-facade' END WHEN kind = 'inspection-only' THEN 'inspect-only'
 WHEN (g > 0 OR e0 > 0) AND kind IS DISTINCT FROM 'runtime-wrapper' THEN 'create-scope-wrapper' WHEN kind = 'source-candidate' AND score >= 70 THEN 'extract-module' WHEN kind = 'wrapper-candidate' AND score >= 55 THEN 'create-scope-wrapper'
 WHEN kind = 'runtime-wrapper' THEN 'wrap-runtime-boundary' ELSE 'inspect-only' END AS action FROM (
 SELECT *, greatest(0, least(raw, CASE WHEN g > 0 AND exports = 0 THEN 48 ELSE 999 END, CASE WHEN e > 12 THEN 45 ELSE 999 END, CASE WHEN lines > 2500 THEN 55 ELSE 999 END, CASE WHEN kind = 'inspection-only' THEN 8 ELSE 999 END)) AS score FROM (
 SELECT *, CASE kind WHEN 'source-candidate' THEN 80 WHEN 'wrapper-candidate' THEN 58 WHEN 'runtime-wrapper' THEN 28 WHEN 'inspection-only' THEN 4 ELSE 0 END + least(exports * 10, 30) + least(declarations * 2, 24) + least(imports * 3, 18)
 - least(g * 14, 45) - least(e * 2, 50) - least(runtimes * 12, 30) - CASE WHEN lines > 2500 THEN 20 WHEN lines > 1000 THEN 8 WHEN lines < 8 AND exports = 0 THEN 10 ELSE 0 END AS raw FROM (
 SELECT *, k % 9 = 0 AS bridge, coalesce(globals, 0) AS g, externals AS e0, CASE WHEN k % 9 = 0 THEN 0 ELSE externals END AS e FROM f)))""", **_PROMOTED))  # fmt: skip
def part_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.promotion(_parts(spark, sf_dir, **_PROMOTED)).select("k", "score", "action")


_SITE = {
    "path": "CASE k % 7 WHEN 0 THEN '/_a/ClientRouter.' || k || '.js' WHEN 1 THEN '_a/theme' || k || '.js' WHEN 2 THEN '/_a/card' || k || '.js' WHEN 3 THEN '_a/client.' || k || '.js' WHEN 4 THEN '_a/index.B' || k || '.js' WHEN 5 THEN '_a/own' || k || '.js' ELSE '_a/none' || k || '.js' END",
    "html": "'<script src=\"/_a/own' || k || '.js\"></script><script src=\"/_a/own' || (k + 7) || '.js\"></script><astro-island component-url=\"/_a/card' || k || '.js\"></astro-island>'",
}


@query(_sql("""SELECT k AS file_id, ['client-router', 'theme', 'component-hydration', 'framework-runtime', 'vendor', 'page-script', 'unknown'][k % 7 + 1] AS role,
 CASE WHEN k % 7 = 5 THEN CASE WHEN k >= 7 THEN 2 ELSE 1 END ELSE 0 END AS pages FROM f"""))  # fmt: skip
def bundle_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_SITE)
    found = N.bundle_roles(rows.selectExpr("k AS file_id", "path"), rows.selectExpr("k AS page_id", "html"), "astro")
    return found.select("file_id", "role", "pages")


_PLACED_PART = {
    "file": "CASE k % 9 WHEN 0 THEN 'x/compiler' || k || '.js' WHEN 1 THEN 'c/' || k || '.js' ELSE 'c/p' || k || '.js' END", "entry": "CASE k % 9 WHEN 2 THEN 'router' WHEN 3 THEN 'sandbox' WHEN 4 THEN 'camera' WHEN 5 THEN 'sketch' END",
    "names": "array(CASE k % 9 WHEN 6 THEN 'Highlight' WHEN 7 THEN 'evalWorker' ELSE 'q' END)", "fragment": "k % 5 = 0", "runnable": "k % 7 <> 0",
    "signal": "CASE k % 4 WHEN 0 THEN 'emscripten-wasm-loader' WHEN 1 THEN 'three-runtime' WHEN 2 THEN 'systemjs-runtime' END",
}


@query(_sql("""SELECT k, CASE WHEN k % 9 = 0 THEN 'src/compiler-runtime' WHEN k % 4 = 0 THEN 'src/wasm' WHEN k % 9 = 2 THEN 'src/vendor-boundaries' WHEN k % 9 = 3 THEN 'src/model-runtime' WHEN k % 9 = 7 THEN 'src/workers'
 WHEN k % 4 = 1 OR k % 9 = 4 THEN 'src/viewport' WHEN k % 9 = 5 THEN 'src/cad-kernel' WHEN k % 9 = 6 THEN 'src/editor' WHEN k % 4 = 2 THEN 'src/vendor-boundaries' ELSE 'src/app' END AS bucket,
 CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'inspection-only runtime/vendor fragment' WHEN k % 4 = 0 THEN 'WASM/runtime bridge' WHEN k % 4 = 1 THEN 'render/vendor runtime' WHEN k % 4 = 2 THEN 'runtime-signaled code' ELSE 'unknown/app-candidate' END AS owner FROM p"""))  # fmt: skip
def part_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_PLACED_PART)
    rows = rows.withColumn("signals", F.when(F.col("signal").isNotNull(), F.array(F.struct(F.col("signal").alias("id"), F.lit("r").alias("role"), F.lit("r").alias("category")))))
    return N.ownership(N.structure(rows)).select("k", "bucket", "owner")


_ASSET = {
    "asset": "CASE k % 10 WHEN 0 THEN 'x/vendor-monaco-editor.' || k || '.js' WHEN 1 THEN 'x/runtime-' || k || '.js' WHEN 2 THEN 'x/cameraState.js' ELSE 'x/' || a || k || '.js' END",
    "package": "CASE k % 10 WHEN 0 THEN 'editor' WHEN 1 THEN 'bundler-runtime' WHEN 2 THEN 'viewport' WHEN 3 THEN 'unheard-of' WHEN 4 THEN 'editor' ELSE 'app-shell' END",
}


@query(_sql("""SELECT t.package, coalesce(g.assets, 0) AS assets, g.best, t.deps, CASE t.package WHEN 'editor' THEN 'inspection-fragments' WHEN 'bundler-runtime' THEN 'preserved-runtime' WHEN 'viewport' THEN 'preserved-runtime' ELSE 'coarse-split' END AS status
 FROM (VALUES ('app-shell', 'react,three'), ('compiler-runtime', ''), ('bundler-runtime', ''), ('wasm-runtime', ''), ('worker-runtime', ''), ('framework-runtime', 'react'), ('editor', 'react,highlight.js'), ('viewport', 'react,three'), ('cad-kernel', 'three'), ('model-project', ''), ('support', '')) AS t(package, deps)
 LEFT JOIN (SELECT CASE package WHEN 'unheard-of' THEN 'support' ELSE package END AS package, count(*) AS assets, max(n) AS best FROM f GROUP BY 1) g USING (package)""", **_ASSET))  # fmt: skip
def package_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, **_ASSET)
    found = rows.selectExpr("CASE k % 4 WHEN 0 THEN 'three' WHEN 1 THEN 'highlight.js' WHEN 2 THEN 'react' ELSE 'other' || k END AS name")
    out = N.package_boundaries(rows.selectExpr("asset", "package", "n AS score"), found)
    return out.select("package", "assets", "best", F.array_join("deps", ",").alias("deps"), "status")


@query(_sql("""SELECT 'public/' || (k - k % 5) || '.wasm' AS wasm, 'js/' || k || '.js' AS file, k % 2 = 0 AS locates, k % 3 = 0 AS instantiates, 4 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS specificity FROM f WHERE k % 7 <> 0"""))
def wasm_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = "CASE WHEN k % 2 = 0 THEN 'locateFile: x, ' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'WebAssembly.instantiate(b); ' ELSE '' END || CASE WHEN k % 7 <> 0 THEN 'load(\"./' || (k - k % 5) || '.wasm\"); \"gone.wasm\"' ELSE '' END"
    rows = _parts(spark, sf_dir, code=code)
    files = rows.selectExpr("'js/' || k || '.js' AS path", "code AS content")
    for folder in ("other", "public"):
        files = files.unionByName(rows.filter("k % 5 = 0").selectExpr(f"'{folder}/' || k || '.wasm' AS path", "CAST(NULL AS STRING) AS content"))
    return N.wasm_contracts(files)


_INDEX = {
    "path": "CASE WHEN k % 50 = 7 THEN a || '/' || k || '/index.html' ELSE a || k || '.html' END",
    "content": "'<html><head x=\"a>b\"><link rel=preload href=\"/f' || k || '.woff2?v=1\"><link href=/s.css></head><body><header class=h>' || a || '</header><script src=\"https://www.googletagmanager.com/x?id=G-AB' || k || '\"></script><footer>' || b || '</footer></body></html>'",
}


@query(_sql("""SELECT '<link rel=preload href="/f' || k || '.woff2?v=1"><link href=/s.css>' AS head, '<header class=h>' || a || '</header>' AS navigation, '<footer>' || b || '</footer>' AS footer, '/f' || k || '.woff2?v=1' AS fonts, 'google-analytics G-AB' || k AS integrations
 FROM f WHERE k % 50 = 7 ORDER BY path LIMIT 1""", **_INDEX))  # fmt: skip
def site_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.layout_parts(_parts(spark, sf_dir, **_INDEX))
    shown = F.array_join(F.transform("integrations", lambda i: F.concat_ws(" ", i["name"], i["package"], i["config"])), ",")
    return found.select("head", "navigation", "footer", F.array_join("fonts", ",").alias("fonts"), shown.alias("integrations"))


@query(_sql("SELECT b || '.js' AS file, min(n) AS first_line, max(n) + 9 AS last_line, least(24, count(*)) AS helpers, 1 AS components, 'React,window' AS kept FROM f WHERE a = 'red' GROUP BY b"))
def focused_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a word, with the first helpers of each; those of other words are left out."""
    rows = _parts(spark, sf_dir, file="b || '.js'", declarations="array('get' || a || k, 'Card', 'plain')", externals="array('React', 'window', 'q' || k)")
    rows = rows.withColumn("at", F.col("k")).withColumn("first_line", F.col("n")).withColumn("last_line", F.col("n") + 9)
    found = N.focus_packets(rows, "getRED")
    return found.select("file", "first_line", "last_line", F.size("helpers").alias("helpers"), F.size("components").alias("components"), F.array_join("kept", ",").alias("kept"))


@query(_sql(""", o AS (SELECT a, count(*) AS files, count(*) FILTER (k % 3 = 0 AND k % 8 <> 0 AND n <= 3 AND k % 2 = 0) AS tiny, count(*) FILTER (k % 3 = 0 AND k % 8 <> 0) AS sources, count(*) FILTER (k % 8 = 0) AS fragments FROM f GROUP BY a),
 t AS (SELECT count(*) FILTER (files >= 100 AND tiny / files > 0.25) AS noisy, sum(fragments) AS fragments, sum(sources) AS sources, sum(files) AS files FROM o)
SELECT 'preserved-runtime-fragments' AS code, 'info' AS severity, 2 AS priority, CAST(fragments AS BIGINT) AS n FROM t WHERE fragments > 0 UNION ALL SELECT 'many-tiny-helper-modules', 'info', 3, noisy FROM t WHERE noisy > 0
 UNION ALL SELECT 'low-source-candidate-ratio', 'warning', 1, CAST(sources AS BIGINT) FROM t WHERE files > 0 AND sources / files < 0.35"""))  # fmt: skip
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, output="a", lines="n", candidate="k % 3 = 0", fragment="k % 8 = 0", exports="CASE WHEN k % 2 = 0 THEN 0 ELSE 2 END")
    return N.audit(rows)
