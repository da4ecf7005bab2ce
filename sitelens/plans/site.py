"""Queries over pages, texts and literal web-application fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.durable import durable
from sitelens.functions import html as H
from sitelens.functions import paths as P
from sitelens.operators import findings as D
from sitelens.registry import query, table
from sitelens.sources import files as S
from sitelens.streaming import state as X

#: About so many items of one or two words are looked for in all texts at a time.
MOST_BARE_ITEMS = 1_000
#: Up to so many inner words of items are a literal set, and up to so many items of so many bytes are broadcast.
MOST_KEYS, MOST_ITEM_BYTES = 20_000, 32 << 20

#: The detectors' own patterns, which SQL reads as well.
_PATTERNS = {d.category: d.pattern for d in D.DETECTORS}
_EMAIL, _PHONE, _IPV4, _TOKEN = (_PATTERNS[c] for c in ("Email Address", "Phone Number", "IPv4 Address", "API Token/Key"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


def _detected(spark: SparkSession, sf_dir: str, category: str) -> DataFrame:
    found = D.matches(_documents(spark, sf_dir), [d for d in D.DETECTORS if d.category == category])
    return found.select(F.col("file_id").alias("doc_id"), F.col("at").alias("nth"), "value")


def _extract(pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
WITH m AS (SELECT doc_id, regexp_extract_all(text, '{p}', {group}) AS v FROM documents),
 e AS (SELECT doc_id, unnest(range(len(v))) AS i, v FROM m)
SELECT doc_id, i AS nth, trim(v[i + 1]) AS value FROM e"""


@query(_extract(_EMAIL, 1))
def findings_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, "Email Address")


@query(_extract(_PHONE, 1))
def findings_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, "Phone Number")


@query(_extract(_IPV4, 1))
def findings_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, "IPv4 Address")


@query(_extract(_TOKEN, 2))
def findings_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir, "API Token/Key")


_PII = [d for d in D.DETECTORS if d.category in ("Email Address", "Phone Number", "IPv4 Address")]


@query(f"""
WITH p AS (SELECT * FROM (VALUES (0, 'IPv4 Address', '{_IPV4}'), (1, 'Email Address', '{_EMAIL}'), (2, 'Phone Number', '{_PHONE}')) AS t(k, category, pattern)),
 m AS (SELECT doc_id, 0 AS k, regexp_extract_all(text, '{_IPV4}', 1) AS v FROM documents UNION ALL SELECT doc_id, 1, regexp_extract_all(text, '{_EMAIL}', 1) FROM documents
  UNION ALL SELECT doc_id, 2, regexp_extract_all(text, '{_PHONE}', 1) FROM documents),
 e AS (SELECT doc_id, k, unnest(range(len(v))) AS i, v FROM m),
 f AS (SELECT doc_id, k, trim(v[i + 1]) AS value, min(i) AS i FROM e GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS rank FROM f)
SELECT doc_id, category, rank, value FROM r JOIN p USING (k) WHERE rank <= 40 ORDER BY doc_id, r.k, i LIMIT 1000
""")
def findings_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.within_total(D.capped(D.values(_documents(spark, sf_dir), _PII), _PII))
    return rows.select(F.col("file_id").alias("doc_id"), "category", "rank", "value")


@query(f"""
WITH m AS (SELECT doc_id, string_split_regex(text, '{_EMAIL}') AS g, regexp_extract_all(text, '{_EMAIL}', 0) AS h FROM documents),
 e AS (SELECT doc_id, g, h, unnest(range(len(h))) AS i FROM m),
 p AS (SELECT doc_id, i, h[i + 1] AS value, array_to_string(list_transform(range(i + 1), lambda k: g[k + 1] || CASE WHEN k < i THEN h[k + 1] ELSE '' END), '') AS head FROM e)
SELECT doc_id, i AS nth, value, length(head) AS "offset", length(head) - length(replace(head, chr(10), '')) + 1 AS line,
 length(list_last(string_split(head, chr(10)))) + 1 AS "column" FROM p
""")
def findings_line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every address, repeated ones included."""
    found = D.matches(_documents(spark, sf_dir), [d for d in D.DETECTORS if d.category == "Email Address"])
    return found.select(F.col("file_id").alias("doc_id"), F.col("at").alias("nth"), "value", "offset", "line", "column")


@query(f"""
WITH m AS (SELECT doc_id, 'pii' AS type, 'Email Address' AS category, len(regexp_extract_all(text, '{_EMAIL}', 1)) AS n FROM documents UNION ALL SELECT doc_id, 'surface', 'IPv4 Address', len(regexp_extract_all(text, '{_IPV4}', 1)) FROM documents
 UNION ALL SELECT doc_id, 'pii', 'Phone Number', len(regexp_extract_all(text, '{_PHONE}', 1)) FROM documents)
SELECT type, category, coalesce(toxic, -1) AS toxic, CAST(sum(n) AS BIGINT) AS findings, count(DISTINCT doc_id) AS files FROM m LEFT JOIN labels USING (doc_id) WHERE n > 0 GROUP BY 1, 2, 3
""")
def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.values(_documents(spark, sf_dir), _PII).groupBy("file_id", "type", "category").agg(F.count("*").alias("n"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    joined = found.join(labels, F.col("file_id") == F.col("doc_id"), "left")
    return joined.groupBy("type", "category", F.coalesce("toxic", F.lit(-1)).alias("toxic")).agg(F.sum("n").alias("findings"), F.count_distinct("file_id").alias("files"))


@query("""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents), e AS (SELECT doc_id, unnest(range(len(v))) AS i, v FROM l)
SELECT doc_id, i + 1 AS line, coalesce(CAST(list_sum(list_transform(v[1:i], lambda x: length(x) + 1)) AS BIGINT), 0) AS start, length(v[i + 1]) AS size FROM e
""")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _documents(spark, sf_dir).select("file_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    before = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(F.col("file_id").alias("doc_id"), (F.col("at") + 1).alias("line"), F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("start"), F.length("text").alias("size"))


@query("SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (text IS NULL) AS missing, max(strlen(text)) AS largest FROM documents GROUP BY 1")
def byte_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.files_from_table(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return files.groupBy(F.col("path").alias("source")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if("missing_content").alias("missing"), F.max("size").alias("largest"))


_KEYWORDS = ("the", "der", "les", "los", "token", "license")


@query("""
WITH c AS (SELECT doc_id, k, len(string_split(lower(text), k)) - 1 AS n FROM documents, (VALUES ('the'), ('der'), ('les'), ('los'), ('token'), ('license')) AS t(k))
SELECT doc_id, k AS keyword, n FROM c WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) = 1
""")
def keyword_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    times = lambda k: ((F.length("low") - F.length(F.replace("low", F.lit(k), F.lit("")))) / len(k)).cast("int")
    counts = [F.struct(times(k).alias("n"), F.lit(k).alias("keyword")) for k in sorted(_KEYWORDS, reverse=True)]
    # Most first; of equal counts the first by name, which array_max finds by the position kept in between.
    ranked = F.array(*[F.struct(c["n"].alias("n"), F.lit(i).alias("i"), c["keyword"].alias("keyword")) for i, c in enumerate(counts)])
    return table(spark, sf_dir, "documents").select("doc_id", low.alias("low")).withColumn("b", F.array_max(ranked)).filter("b.n > 0").select("doc_id", "b.keyword", "b.n")


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)), '') AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(H.tag_text(F.col("html"), "title"), F.lit("")).alias("title"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s+[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS href FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))


@query("SELECT page_id, length(trim(regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1))) AS size, md5(trim(regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1))) AS digest FROM pages")
def page_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = H.body(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(inside).alias("size"), F.md5(inside).alias("digest"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<footer[^>]*>(.*?)</footer>', 1)), '') AS footer FROM pages")
def page_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(H.footer(F.col("html")), F.lit("")).alias("footer"))


@query("""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug FROM pages
""")
def page_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.slug(F.col("url")).alias("slug"))


@query("""
WITH r AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/$', '') || '.html' AS path FROM pages)
SELECT page_id, path, '/' || regexp_replace(regexp_replace(path, '\\.html$', ''), '/index$', '') AS route FROM r
""")
def page_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), r"/\z", ""), F.lit(".html"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), P.route_of(path).alias("route"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def url_host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host")
    return table(spark, sf_dir, "pages").groupBy(host).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query("""
WITH s AS (SELECT page_id, strlen(html) AS bytes, string_split(regexp_extract(url, '^[a-z]+://([^?#]+)', 1), '/') AS v FROM pages),
 e AS (SELECT bytes, v, unnest(range(1, len(v) + 1)) AS depth FROM s)
SELECT depth, array_to_string(v[1:depth], '/') AS prefix, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM e GROUP BY 1, 2
""")
def path_prefix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/")
    pages = table(spark, sf_dir, "pages").select(F.octet_length("html").alias("bytes"), parts.alias("v"))
    # A prefix row carries one number, not the page.
    each = pages.select("bytes", F.explode(F.transform("v", lambda _, k: F.struct((k + 1).alias("depth"), F.array_join(F.slice("v", F.lit(1), k + 1), "/").alias("prefix")))).alias("p"))
    return each.groupBy("p.depth", "p.prefix").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))


@query("""
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s+[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS href FROM pages)
SELECT href, count(*) AS pages, min(page_id) AS first_page FROM l GROUP BY 1 HAVING count(*) > 1
""")
def shared_link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that several pages link to, counted by key instead of by joining pages with pages."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(H.hrefs(F.col("html")))).alias("href"))
    return links.groupBy("href").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).filter("pages > 1")


@query("""
WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL), f AS (SELECT digest, min(doc_id) AS first_id, count(*) AS n FROM h GROUP BY 1)
SELECT doc_id, first_id FROM h JOIN f USING (digest) WHERE doc_id <> first_id
""")
def exact_hash_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = hashed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    return hashed.join(first, "digest").filter("doc_id <> first_id").select("doc_id", "first_id")


@query("SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)")
def theta_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that contain an item.

    A word inside an item, neither its first nor its last, stands in the text as a whole
    word, so such a word is an equality key: the one that the fewest texts have. Up to a
    bound the keys are a literal set, items are broadcast and texts don't move; beyond, words
    are joined by a shuffle and only texts with a match follow. Items without an inner word
    are compared with all texts, a block of them at a time.
    """
    items = table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", F.col("text").alias("item"))
    words = F.split("item", r"\s+")
    items = items.withColumn("inner", F.array_distinct(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))))
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    each = items.select("item_id", F.explode("inner").alias("word"))
    vocabulary = durable(each.select("word").distinct())
    few = vocabulary.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    present = F.array_distinct(F.split("text", r"\s+"))

    def among(known: DataFrame) -> Column:
        wanted = sorted(r.word for r in known.collect())
        return F.filter(present, lambda w: w.isin(wanted))

    held = docs.select("doc_id", F.explode(among(vocabulary) if few else present).alias("word"))
    frequency = held.join(F.broadcast(vocabulary) if few else vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    # A word that no text has keeps its item from all texts.
    rarest = each.join(frequency, "word").groupBy("item_id").agg(F.min(F.struct("n", "word"))["word"].alias("word"), F.count("*").alias("known"))
    keyed = durable(items.filter(F.size("inner") > 0).join(rarest.withColumnRenamed("item_id", "_id"), F.col("item_id") == F.col("_id")).filter(F.col("known") == F.size("inner")).select("item_id", "item", "word"))
    count, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()
    if few and count <= MOST_KEYS and size <= MOST_ITEM_BYTES:  # many items can share few words
        met = docs.select("doc_id", "text", F.explode(among(keyed.select("word").distinct())).alias("word")).join(F.broadcast(keyed), "word")
    else:
        pairs = docs.select("doc_id", F.explode(present).alias("word")).join(keyed, "word").select("doc_id", "item_id", "item")
        met = pairs.join(docs, "doc_id")
    found = met.filter("contains(text, item)").select("item_id", "doc_id")
    bare = items.filter(F.size("inner") == 0).select("item_id", "item")
    blocks = -(-bare.count() // MOST_BARE_ITEMS)
    for k in range(blocks):
        block = bare.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == k)
        found = found.unionByName(docs.join(F.broadcast(block), F.expr("contains(text, item)")).select("item_id", "doc_id"))
    return found


@query("""
SELECT user_id AS job_id, max(event_id) AS seq, arg_max(CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'ready' ELSE 'working' END, event_id) AS status FROM events GROUP BY 1
""")
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest_state(job_messages(table(spark, sf_dir, "events"))).select("job_id", "seq", "status")


def job_messages(events: DataFrame) -> DataFrame:
    """Events read as job messages."""
    status: Column = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "ready").otherwise("working")
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("value").alias("progress"), F.col("props").alias("error"))


@query("""
SELECT user_id AS job_id, max(event_id) AS seq, arg_max(CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'ready' ELSE 'working' END, event_id) AS status FROM events GROUP BY 1
""")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream; each micro-batch replaces the jobs it changed."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = X.batches_to_table(X.stream_latest_state(job_messages(stream)))
    return rows.groupBy("job_id").agg(F.max_by(F.struct("seq", "status"), "seq").alias("s")).select("job_id", "s.*")
