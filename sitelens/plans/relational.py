"""Queries of joins, aggregations, windows and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.operators import ranges, scoring
from sitelens.registry import query, table


@query("""
WITH v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
 p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
 m AS (SELECT p.event_id, p.user_id, max(struct_pack(t := v.ts, i := v.event_id)) AS s
       FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY 1, 2)
SELECT event_id, user_id, s.i AS view_id FROM m
""")
def asof_view_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    views = events.filter("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("view_id"))
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "at")
    found = ranges.as_of(purchases, views, ["user_id"], "at", ["view_id"], tie="view_id")
    return found.select("event_id", "user_id", "view_id")


@query("""
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(latest).select("user_id", "e.*")


@query("""
WITH a AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_event FROM b GROUP BY user_id, run
""")
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = ranges.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return marked.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""
WITH a AS (SELECT user_id, event_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000 THEN 1 ELSE 0 END AS c
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM a)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 2) AS total FROM b GROUP BY user_id, session
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    marked = ranges.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], at, ["ts", "event_id"], 86400)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _item_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("day_from"), (day + F.col("l_quantity").cast("int")).alias("day_to"))


_MERGED = """
WITH s AS (SELECT l_suppkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS b FROM lineitem),
 r AS (SELECT *, max(b) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
 n AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM r),
 m AS (SELECT l_suppkey, min(a) AS day_from, max(b) AS day_to, count(*) AS parts FROM n GROUP BY l_suppkey, g)
"""


@query(_MERGED + "SELECT l_suppkey, CAST(day_from AS INT) AS day_from, CAST(day_to AS INT) AS day_to, parts FROM m")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.interval_union(_item_spans(spark, sf_dir), ["l_suppkey"], "day_from", "day_to")


@query(_MERGED + """
, g AS (SELECT l_suppkey, lag(day_to) OVER (PARTITION BY l_suppkey ORDER BY day_from) AS gap_start, day_from AS gap_end FROM m)
SELECT l_suppkey, CAST(gap_start AS INT) AS gap_start, CAST(gap_end AS INT) AS gap_end FROM g WHERE gap_start IS NOT NULL
""")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.interval_gaps(ranges.interval_union(_item_spans(spark, sf_dir), ["l_suppkey"], "day_from", "day_to"), ["l_suppkey"], "day_from", "day_to")


@query("""
WITH b AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer),
 d AS (SELECT *, CASE WHEN lag(k) OVER w = k - 1 THEN 0 ELSE 1 END AS c FROM b WINDOW w AS (PARTITION BY s ORDER BY k)),
 e AS (SELECT *, sum(c) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM d)
SELECT s AS segment, min(k) AS key_from, max(k) AS key_to FROM e GROUP BY s, g
""")
def adjacent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key_from"), F.col("c_custkey").alias("key_to"))
    return ranges.merge_adjacent(rows, ["segment"], "key_from", "key_to")


@query("""
SELECT grouping_id(r_name, n_name, c_mktsegment) AS level, r_name, n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total, count(*) AS n
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
GROUP BY ROLLUP (r_name, n_name, c_mktsegment)
""")
def treemap_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders are summed per customer before any dimension joins in: one shuffle of partial sums.
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("part"), F.count("*").alias("rows"))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    total = rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.grouping_id().alias("level"), F.round(F.sum("part"), 2).alias("total"), F.sum("rows").alias("n"))
    return total.select("level", "r_name", "n_name", "c_mktsegment", "total", "n")


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, round(sum(l_quantity), 4) AS score, count(*) AS evidence FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey AS winner, score, evidence FROM s QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey) = 1
""")
def scoreboard_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = scoring.scoreboard(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", "l_quantity")
    return board.filter("rank = 1").select("l_partkey", F.col("l_suppkey").alias("winner"), "score", "evidence")


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, round(sum(l_quantity), 4) AS score FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey) AS k FROM s)
SELECT l_partkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY k) AS alternatives FROM r WHERE k BETWEEN 2 AND 5 GROUP BY l_partkey
""")
def scoreboard_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = scoring.scoreboard(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey", "l_quantity").filter("rank between 2 and 5")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("l_suppkey").cast("string").alias("name"))))
    return board.groupBy("l_partkey").agg(F.array_join(F.transform(listed, lambda x: x["name"]), ",").alias("alternatives"))


@query("""
WITH o AS (SELECT l_suppkey, l_partkey, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS exact, max(l_extendedprice) AS bytes FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(sum(exact) AS BIGINT) AS exact_files, CAST(sum(1 - exact) AS BIGINT) AS related_files,
 round(sum(CASE WHEN exact = 1 THEN bytes ELSE 0 END), 2) AS exact_bytes, round(sum(CASE WHEN exact = 0 THEN bytes ELSE 0 END), 2) AS related_bytes
FROM o GROUP BY l_suppkey
""")
def evidence_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files count once a package, and as related only where they aren't exact."""
    exact = F.max((F.col("l_returnflag") == "N").cast("int")).alias("exact")
    files = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(exact, F.max("l_extendedprice").alias("bytes"))
    return files.groupBy("l_suppkey").agg(
        F.sum("exact").alias("exact_files"),
        F.sum(1 - F.col("exact")).alias("related_files"),
        F.round(F.sum(F.when(F.col("exact") == 1, F.col("bytes")).otherwise(0.0)), 2).alias("exact_bytes"),
        F.round(F.sum(F.when(F.col("exact") == 0, F.col("bytes")).otherwise(0.0)), 2).alias("related_bytes"),
    )


@query("""
SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.75 THEN 'high' WHEN c_acctbal / 10000 >= 0.45 THEN 'medium' ELSE 'low' END AS confidence,
 CAST(least(48, 18 + 12 * (c_custkey % 4)) AS BIGINT) AS import_score, CAST(least(28, 10 + 3 * (c_custkey % 8)) AS BIGINT) AS site_score,
 CAST(round(least(0.95, 0.45 + 0.16 * (c_custkey % 5)), 6) AS DOUBLE) AS signal FROM customer
""")
def confidence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k,
        scoring.confidence_label(F.col("c_acctbal") / 10000).alias("confidence"),
        scoring.import_score(k % 4).cast("long").alias("import_score"),
        scoring.site_score(k % 8).cast("long").alias("site_score"),
        scoring.signal_confidence(k % 5).alias("signal"),
    )


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_acctbal >= 7500 THEN 3 WHEN s_acctbal >= 4500 THEN 2 ELSE 1 END AS label, round(s_acctbal / 100, 0) AS score, length(s_name) AS size, s_name FROM supplier)
SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY label DESC, score DESC, size DESC, s_name) AS rank FROM s
""")
def package_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("s_acctbal") >= 7500, 3).when(F.col("s_acctbal") >= 4500, 2).otherwise(1)
    order = Window.partitionBy("s_nationkey").orderBy(F.desc("label"), F.desc("score"), F.desc("size"), "s_name")
    rows = table(spark, sf_dir, "supplier").withColumns({"label": label, "score": F.round(F.col("s_acctbal") / 100, 0), "size": F.length("s_name")})
    return rows.select("s_suppkey", "s_nationkey", F.row_number().over(order).alias("rank"))


@query("""
SELECT o_orderpriority, count(*) AS files, count(*) FILTER (o_totalprice < 50000) AS tiny, round(count(*) FILTER (o_totalprice < 50000) / count(*), 6) AS ratio
FROM orders GROUP BY 1 HAVING count(*) >= 100 AND count(*) FILTER (o_totalprice < 50000) / count(*) > 0.05
""")
def having_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiny = F.count_if(F.col("o_totalprice") < 50000)
    audit = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("files"), tiny.alias("tiny"), (tiny / F.count("*")).alias("raw"))
    return audit.filter("files >= 100 and raw > 0.05").select("o_orderpriority", "files", "tiny", F.round("raw", 6).alias("ratio"))


@query("""
SELECT coalesce(l_returnflag, 'total') AS kind, count(*) AS files, count(*) FILTER (l_linestatus = 'O') AS changed, round(sum(l_extendedprice), 2) AS bytes_in, round(sum(l_extendedprice * (1 - l_discount)), 2) AS bytes_out
FROM lineitem GROUP BY ROLLUP (l_returnflag)
""")
def kind_summary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("l_linestatus") == "O").alias("changed"),
        F.round(F.sum("l_extendedprice"), 2).alias("bytes_in"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("bytes_out"),
    )
    return rows.select(F.coalesce("l_returnflag", F.lit("total")).alias("kind"), "files", "changed", "bytes_in", "bytes_out")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def companion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 400000")
    return large.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def semi_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49")
    return table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("""
SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 40)
""")
def anti_reserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 40")
    free = table(spark, sf_dir, "part").filter("p_brand not in ('Brand#1', 'Brand#2')")
    return free.join(declared, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query("""
WITH d AS (SELECT l_partkey, min(l_orderkey) AS definer FROM lineitem GROUP BY 1)
SELECT l_orderkey AS user_key, definer, count(DISTINCT lineitem.l_partkey) AS symbols FROM lineitem JOIN d ON d.l_partkey = lineitem.l_partkey WHERE l_orderkey <> definer GROUP BY 1, 2
""")
def first_definer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    definer = items.groupBy("l_partkey").agg(F.min("l_orderkey").alias("definer"))
    edges = items.join(definer, "l_partkey").filter("l_orderkey <> definer")
    return edges.groupBy(F.col("l_orderkey").alias("user_key"), "definer").agg(F.count("*").alias("symbols"))


@query("""
WITH RECURSIVE e(src, dst) AS (SELECT n_nationkey, (n_nationkey * 7 + 3) % 25 FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation),
 c(root, node) AS (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT c.root, e.dst FROM c JOIN e ON e.src = c.node)
SELECT root, node FROM c
""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    edges = edges.unionByName(nation.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"))).distinct()
    return scoring.closure(edges, nation.filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").alias("root"))).select("root", "node")


@query("""
SELECT coalesce(s.k, c.k) AS nation_key, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM
 (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s.k = c.k
""")
def full_outer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.count("*").alias("s"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation_key")).agg(F.count("*").alias("c"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    return s.join(c, "nation_key", "full").select("nation_key", zero("s").alias("suppliers"), zero("c").alias("customers"))


@query("""
WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)
SELECT p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || k END AS unique_name FROM n
""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.unique_names(table(spark, sf_dir, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""
WITH h AS (SELECT o_custkey, min(o_orderpriority) AS hint FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE hint END AS hint, o_orderstatus <> 'P' AND hint IS NOT NULL AS inherited
FROM orders LEFT JOIN h ON h.o_custkey = orders.o_custkey
""")
def inherited_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    hints = orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("hint"))
    own = F.col("o_orderstatus") == "P"
    joined = orders.join(hints, "o_custkey", "left")
    return joined.select("o_orderkey", F.when(own, F.col("o_orderpriority")).otherwise(F.col("hint")).alias("hint"), (~own & F.col("hint").isNotNull()).alias("inherited"))


@query("""
SELECT * FROM (SELECT p_partkey, 'large' AS kind FROM part ORDER BY p_size DESC, p_partkey LIMIT 20)
UNION ALL SELECT * FROM (SELECT p_partkey, 'dear' FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)
UNION ALL SELECT * FROM (SELECT p_partkey, 'promo' FROM part WHERE p_type LIKE 'PROMO%' ORDER BY p_retailprice, p_partkey LIMIT 5)
""")
def top_k_union_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.lit(True)
    parts = [
        ("large", every, [F.desc("p_size"), F.asc("p_partkey")], 20),
        ("dear", every, [F.desc("p_retailprice"), F.asc("p_partkey")], 10),
        ("promo", F.col("p_type").startswith("PROMO"), [F.asc("p_retailprice"), F.asc("p_partkey")], 5),
    ]
    return scoring.quota_union(table(spark, sf_dir, "part"), parts).select("p_partkey", "kind")


@query("SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text) = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.first_by(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.desc("turn"), "text"]).select("conv_id", "role", "turn", "text")


@query("SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.first_by(table(spark, sf_dir, "conversations"), ["conv_id", "role"], ["turn", "text"]).select("conv_id", "role", "turn", "text")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.union(b).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.subtract(b)


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    return a, table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"), parsed.isNotNull().alias("valid"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2
""")
def readiness_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")
    )


def _fold_sql(into: str, joins: str) -> str:
    """A fold over the turns of each conversation as recursion: the row joins the group before it or begins the next."""
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(length(text), 0) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 f AS (SELECT conv_id, turn, size, k, size AS filled, 0 AS nth FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.size, t.k, CASE WHEN {joins} THEN f.filled + t.size ELSE t.size END, CASE WHEN {joins} THEN f.nth ELSE f.nth + 1 END
  FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, turn, size, nth AS {into} FROM f
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("size"))


@query(_fold_sql("bin", "f.filled = 0 OR f.filled + t.size <= 1500"))
def greedy_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.fold_groups(_turns(spark, sf_dir), ["conv_id"], ["turn"], "size", ranges.greedy_bins(1500), "bin")


@query(_fold_sql("cluster", "f.filled + t.size <= 4000 AND (t.size < 120 OR f.size < 120)"))
def cluster_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.fold_groups(_turns(spark, sf_dir), ["conv_id"], ["turn"], "size", ranges.cluster_fold(120, 4000), "cluster")
