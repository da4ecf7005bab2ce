"""Operators on small literal rows, odd ones included."""

import base64
import json

from pyspark.sql import functions as F

from sitelens.functions import html, paths
from sitelens.operators import findings, ranges, scoring
from sitelens.sources import files, sourcemaps
from sitelens.streaming import state


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_paths(spark):
    p = F.col("p")
    for path, route in (("index.html", "/"), ("a/index.html", "/a"), ("a/b.html", "/a/b")):
        assert one(spark, paths.route_of(p), p=path) == route
    assert one(spark, paths.package_of_path(p), p="a/node_modules/x/node_modules/@s/y/i.js") == "@s/y"
    assert one(spark, paths.package_of_path(p), p="src/a.js") is None
    assert one(spark, paths.resolve_relative_path(F.lit("a/b/c.js"), p), p="../d.js") == "a/d.js"
    assert one(spark, paths.resolve_relative_path(F.lit("a/b/c.js"), p), p="https://h/x.js") == "https://h/x.js"
    assert one(spark, paths.basename(p), p="a/b/c.min.js") == "c.min"
    assert one(spark, paths.slug(p), p="Hello, Wörld!") == "hello-w-rld"
    assert one(spark, paths.byte_size(F.octet_length(p)), p="x" * 1536) == "1.5 KB"


def test_unlikely_secrets(spark):
    rows = [("abc", True), ("12345678", True), ("MY_CONST_VALUE", True), ("camelCaseName", True), ("9f8e7d6c5b4a", False), ("my_service_api_key", False), ("menu_group_item", True), ("undefined", True), ("abc-def12", False), ("abcdefgh\n", False), ("UNSAFE_xyz", True), ("_getString", True), ("a_b_c_d_e_token", False), ("x_1__y9zzz", False)]
    got = spark.createDataFrame(rows, "v string, w boolean").select("v", "w", findings.unlikely_secret(F.col("v")).alias("x")).collect()
    assert all(r.w == r.x for r in got), got


def test_findings_have_places_and_caps(spark):
    text = "é mail a@b.org\n  then\n\n a@b.org c@d.org token = '9f8e7d6c5b4a' api_key: name_of_it https://x.y/z?q 1.2.3.4"
    many = " ".join(f"u{k}@h.org" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, many), (3, None), (4, "")], "file_id long, content string")
    found = findings.matches(docs)
    assert all(text[r.offset :].startswith(r.value) for r in found.filter("file_id = 1").collect())
    plain = findings.values(docs).select("file_id", "pattern_order", "category", "type", "at", "value")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, found.select(*plain.columns).collect()))
    kept = findings.capped(found)
    rows = [(r.category, r.value) for r in kept.filter("file_id = 1").collect()]
    assert sorted(rows) == [("API Token/Key", "9f8e7d6c5b4a"), ("Email Address", "a@b.org"), ("Email Address", "c@d.org"), ("IPv4 Address", "1.2.3.4"), ("URL", "https://x.y/z?q")]
    assert kept.filter("file_id = 2").count() == 40 and findings.within_total(kept, 7).count() == 7
    placed = {r.value: r for r in findings.with_snippet(kept, docs).filter("file_id = 1").collect()}
    assert (placed["c@d.org"].line, placed["c@d.org"].column) == (4, 10) and placed["a@b.org"].snippet == "é mail a@b.org"


def test_every_place_and_one_scan(spark):
    """Repeated values, values of several lines and helpers of transpiled code, against the text itself."""
    import re

    call = "return x(this, void 0, void 0, function() { return y(this, function("
    text = f"a@b.org a@b.org\n\na@b.org gql`\nquery\n` a@b.org\ntoken:\n'9f8e7d6c5b4a'\nvoid 0===a&&(b=1), void 0===c && (d=2); {call}\nObject.defineProperty(X.prototype, 'k', {{ get: function __extends"
    files = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "file_id string, content string")
    found = findings.matches(files)
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().toString()) and plan.split("Physical")[1].count("Scan") == 1
    rows = found.collect()
    for r in rows:
        head = text[: r.offset]
        assert text[r.offset :].startswith(r.value) and (r.line, r.column) == (head.count("\n") + 1, len(head) - head.rfind("\n")), r
    assert sum(r.category == "Email Address" for r in rows) == len(re.findall("a@b.org", text)) == 4
    assert {"GraphQL Query", "API Token/Key", "Comma Operator Chain", "TypeScript Async Helper", "TypeScript Class Helper"} <= {r.category for r in rows}
    assert sum(r.category == "TypeScript Class Helper" for r in rows) == 2


def test_folds_hold_state_across_batches(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else None, k, (k * 37) % 90) for k in range(3000)], "g int, at int, size int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = ranges.fold_groups(rows, ["g"], ["at"], "size", ranges.greedy_bins(200), "bin").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in (None, 1, 2):
        mine = sorted((r.at, r.size, r.bin) for r in got if r.g == g)
        assert [b for _, _, b in mine] == ranges.fold(ranges.greedy_bins(200), [s for _, s, _ in mine]) and len(mine) == 1000


def test_as_of_and_ranges(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 3, "d")], "k int, at int, id string")
    right = spark.createDataFrame([(1, 2, 7, 1), (1, 5, 8, 1), (1, 5, 9, 2), (2, 10, 1, 1)], "k int, at int, v int, seq int")
    got = {r.id: r.v for r in ranges.as_of(left, right, ["k"], "at", ["v"], tie="seq").collect()}
    assert got == {"a": 9, "b": None, "c": None, "d": None}
    spans = spark.createDataFrame([("A", 0, 4), ("A", 5, 9), ("A", 11, 12), ("B", 13, 15)], "s string, a int, b int")
    assert sorted(map(tuple, ranges.merge_adjacent(spans, ["s"], "a", "b").collect())) == [("A", 0, 9), ("A", 11, 12), ("B", 13, 15)]
    named = ranges.unique_names(spark.createDataFrame([(k, n) for k, n in enumerate("abaa")], "i int, n string"), "n", ["i"])
    assert [r.unique_name for r in named.orderBy("i").collect()] == ["a", "b", "a-2", "a-3"]
    assert ranges.fold(ranges.greedy_bins(10), [4, 5, 6, 20, 1]) == [0, 0, 1, 2, 3] and ranges.fold(ranges.cluster_fold(3, 10), [5, 1, 5, 5]) == [0, 0, 1, 2]


def test_scores(spark):
    n = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int")
    assert [r[0] for r in n.select(scoring.import_score(F.col("n"))).collect()] == [30, 42, 48, 48]
    assert [r[0] for r in n.select(scoring.signal_confidence(F.col("n"))).collect()] == [0.61, 0.77, 0.93, 0.95]
    board = spark.createDataFrame([(1, "viewport", 5.0), (1, "editor", 3.0), (1, "editor", 2.0), (1, "support", 3.0)], "a int, p string, w double")
    assert [r.p for r in scoring.scoreboard(board, ["a"], "p", "w").orderBy("rank").collect()] == ["editor", "viewport", "support"]


def test_sources(spark, tmp_path):
    assert one(spark, files.data_url_text(F.col("u")), u="data:application/json;base64," + base64.b64encode("é{}".encode()).decode()) == "é{}"
    assert one(spark, files.data_url_text(F.col("u")), u="data:,a%20b+c") == "a b+c" and one(spark, files.data_url_text(F.col("u")), u="x.map") is None
    assert one(spark, files.valid_wasm(F.col("b")), b=b"\0asm\1") and not one(spark, files.valid_wasm(F.col("b")), b=b"<htm")
    for name in ("a.js", "a.js.map", "node_modules/x.js", "c/d.css"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("é")
    found = files.files_from_dir(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.js", "a.js.map", "d.css"] and {r.content for r in found.collect()} == {"é"}
    assert files.bundle_files(found).count() == 2
    pairs = {r.path.rsplit("/", 1)[1]: r.map_path for r in files.with_companion(found).collect()}
    assert pairs["d.css"] is None and pairs["a.js"].endswith("a.js.map")
    maps = spark.createDataFrame([('{"version":3,"sources":[]}',), ('{"version":2,"sources":[]}',), ("x",), ('{"version":3}',), (")]}'\n" + '{"version":3,"sections":[]}',)], "content string")
    assert [r.valid for r in files.validated_maps(maps).collect()] == [True, False, False, False, True]


def test_mappings(spark):
    rows = [("m", json.dumps({"version": 3, "sources": ["s"], "mappings": "AAAA;AACA;AACA"})), ("bad", "{"), ("none", None), ("odd", '{"mappings":"!!"}')]
    got = sourcemaps.mappings(spark.createDataFrame(rows, "map_id string, content string")).collect()
    assert [(r.gen_line, r.orig_line, r.orig_column, r.source) for r in got] == [(k, k, 0, "s") for k in (1, 2, 3)]
    index = {"version": 3, "sections": [{"offset": {"line": 0, "column": 0}, "map": {"sources": ["a"], "mappings": "AAAA"}}, {"offset": {"line": 2, "column": 5}, "map": {"sources": ["b"], "mappings": "AAAA;AACA"}}]}
    got = sourcemaps.mappings(spark.createDataFrame([("i", json.dumps(index))], "map_id string, content string")).collect()
    assert [(r.gen_line, r.gen_column, r.source, r.orig_line) for r in got] == [(1, 0, "a", 1), (3, 5, "b", 1), (4, 0, "b", 2)]
    texts = sourcemaps.original_files(spark.createDataFrame([("m", '{"sources":["a","b"],"sourcesContent":["é"]}')], "map_id string, content string")).collect()
    assert [(r.source, r.size, r.missing_content) for r in texts] == [("a", 2, False), ("b", 0, True)]


def test_html(spark):
    h = F.col("h")
    page = "<a class=x href='/y'>t</a><a href=z>u</a><title>  </title><script src='a.js'>no</script><astro-island x>"
    assert one(spark, html.hrefs(h), h=page) == ["/y", "z"] and one(spark, html.framework(h), h=page) == "astro"
    assert one(spark, html.inline_scripts(h), h=page) == [] and one(spark, html.linked_scripts(h), h=page) == ["a.js"]
    assert one(spark, html.body(h), h="no body") == "" and one(spark, html.tag_text(h, "title"), h="<p>") is None


def test_attributes_styles_and_islands(spark):
    h = F.col("h")
    page = """<META content='a > b' NAME="d"><meta property=og:x content=""><meta name=k content=1><meta name=k content=2><link href="/a.css?v=1" rel=stylesheet><link href=icon.png>
    <script type="module" src="/assets/i.js"></script><script data-src="x"> let a = 1 </script><script>if (a < b) {}</script>
    <astro-island component-url="/_a/my-nice_card.B1.js" component-export="default" renderer-url="/_a/client.C2.js" props="{&quot;n&quot;:[0,1]}" client="idle"></astro-island>
    <astro-island component-url="/x/w.js" component-export="Wide" renderer-url="/vue.js" props="{bad"></astro-island>"""
    assert one(spark, html.meta_tags(h), h=page) == {"d": "a > b", "k": "2"}
    assert one(spark, html.inline_scripts(h), h=page) == ["let a = 1"] and one(spark, html.linked_scripts(h), h=page) == ["/assets/i.js"]
    assert one(spark, html.stylesheets(h), h=page) == ["/a.css?v=1"] and one(spark, html.framework(h), h=page) == "astro"
    assert one(spark, html.framework(h), h='<script src="/assets/i.js" type=module>') == "vite" and one(spark, html.framework(h), h="<p>") == "unknown"
    assert [tuple(i) for i in one(spark, html.islands(h), h=page)] == [("MyNiceCard", "/_a/my-nice_card.B1.js", "react", "idle", '{"n":[0,1]}'), ("Wide", "/x/w.js", "vue", "load", "{}")]
    css = ":root{--main: #fff; --gap:2px} /* --not: 1; */ @media x { a:hover{--main: #000;font-family:'Inter', serif} } b{FONT-FAMILY:Mono, x}"
    assert one(spark, html.css_properties(h), h=css) == {"--main": "#000", "--gap": "2px"} and one(spark, html.font_families(h), h=css) == ["Inter", "Mono, x"]
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    files = spark.createDataFrame([("f", "x/w.js"), ("g", "/other.js")], "file_id string, path string")
    assert sorted((r.component, r.file_id) for r in html.island_files(pages, files).collect()) == [("MyNiceCard", None), ("Wide", "f")]


def test_job_state(spark):
    rows = [(1, 1, "queued", 0.0, None), (1, 3, "ready", 1.0, None), (1, 2, "error", 0.5, "boom"), (2, 1, "error", 0.1, "bad"), (3, 1, "working", 0.2, "stale")]
    states = state.latest_state(spark.createDataFrame(rows, "job_id long, seq long, status string, progress double, error string"))
    assert {r.job_id: (r.status, r.error, r.done) for r in states.collect()} == {1: ("ready", None, True), 2: ("error", "bad", True), 3: ("working", None, False)}
    assert state.batch_complete(states).first().asDict() == {"jobs": 3, "finished": 2, "complete": False}
    assert state.batch_complete(states.limit(0)).first().jobs == 0


def test_lookups(spark):
    text = '{"version":3,"sources":["a.js"],"names":["x","y"],"sections":[],"mappings":"AAAA,IAAIA;AACA,EAAA"}'
    maps = spark.createDataFrame([("m", text), ("s", '{"sections":[{"map":{"names":["q"]}}]}'), ("bad", "{")], "map_id string, content string")
    found = sourcemaps.mappings(maps.filter("map_id = 'm'"))
    asks = spark.createDataFrame([(1, "m", 1, 3), (2, "m", 1, 4), (3, "m", 1, 90), (4, "m", 7, 0)], "ask_id int, map_id string, gen_line long, gen_column long")
    got = {r.ask_id: (r.found, r.orig_line, r.orig_column, r.name) for r in sourcemaps.lookup_generated(found, asks).collect()}
    assert got == {1: (True, 1, 0, None), 2: (True, 1, 4, "x"), 3: (True, 1, 4, "x"), 4: (False, None, None, None)}
    back = spark.createDataFrame([(1, "m", "a.js", 2, 4), (2, "m", "a.js", 9, 9)], "ask_id int, map_id string, source string, orig_line long, orig_column long")
    got = {r.ask_id: [tuple(p) for p in r.matches] for r in sourcemaps.lookup_original(found, back).collect()}
    assert got == {1: [(2, 0), (2, 2)], 2: []}
    assert {r.map_id: r.names for r in sourcemaps.name_counts(maps).collect()} == {"m": 2, "s": 1, "bad": 0}


def test_fingerprints(spark):
    from sitelens.operators import fingerprints as P

    rows = [("1", "x/my.worker.js", "self.onmessage = 1; postMessage(2); importScripts('a'); new Worker('b'); createRoot(x)"), ("2", "a.js", "module.exports = require('x')"), ("3", "b.js", "import y from 'z'"), ("4", "c.js", None)]
    files = spark.createDataFrame(rows, "file_id string, path string, content string")
    found = {(r.file_id, r.id): (len(r.evidence), r.confidence) for r in P.signals(files).collect()}
    assert found == {("1", "worker-runtime"): (4, 0.95), ("1", "inline-wasm-worker"): (1, 0.61)}
    assert [(r.file_id, r.id) for r in P.primary_signal(P.signals(files)).collect()] == [("1", "worker-runtime")]
    assert [(r.file_id, r.id) for r in P.signals(files, P.DEPENDENCIES).collect()] == [("1", "react-dom")]
    assert P.module_type(files).first().type == "module"


def test_long_chains_and_tags_take_no_stack(spark):
    chain = ", ".join(f"void 0 === a{k} && (a{k} = {k})" for k in range(5000))
    files = spark.createDataFrame([("f", f"x; {chain};"), ("g", "void 0===a&&(a=1)")], "file_id string, content string")
    found = [r for r in findings.matches(files).collect() if r.category == "Comma Operator Chain"]
    assert [(r.file_id, r.value) for r in found] == [("f", chain)]
    h = F.col("h")
    long = "a='b' c " * 20_000
    assert one(spark, html.linked_scripts(h), h=f"<script {long}src=x></script><script {long}") == ["x"]
    assert one(spark, html.meta_tags(h), h=f"<meta {long}name=x content=y>") == {"x": "y"}
