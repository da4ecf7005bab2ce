from pyspark.sql import functions as F

from sitelens.functions import predicates as Q
from sitelens.functions import text as X
from sitelens.operators import lines
from sitelens.sources import resolve

from .test_operators import one


def test_names_and_literals(spark):
    t = F.col("t")
    assert one(spark, X.split_words(t), t="fooBar-baz_qux2Zed") == ["foo", "bar", "baz", "qux2", "zed"]
    assert one(spark, X.title_case(t), t="fooBar") == "Foo Bar" and one(spark, X.camel_case(t), t="Foo bar-baz") == "fooBarBaz"
    assert one(spark, X.is_minified(t), t="a1") and not one(spark, X.is_minified(t), t="abc") and one(spark, X.is_identifier(t), t="$a_1")
    assert one(spark, X.occurrences(t, F.lit("aa")), t="aaaaa") == 2 and one(spark, X.occurrences(t, F.lit("")), t="a") == 0
    assert one(spark, X.normalized_code(t), t="a  \r\nb\t\n\n\n") == "a\nb\n" and one(spark, X.line_ending(t), t="a\r\nb") == "\r\n"
    assert one(spark, X.html_escaped(t), t="<a b=\"'&\">") == "&lt;a b=&quot;&#39;&amp;&quot;&gt;"
    assert [tuple(x) for x in one(spark, X.export_aliases(t), t="export { a as b, c };")] == [("a", "b"), ("c", "c")]
    assert one(spark, X.large_literals(t, 6), t="x('abcdef', \"a\\\"bcd\", `q`)") == ["'abcdef'", '"a\\"bcd"']
    assert one(spark, X.header_lines(t), t="A: 1\r\nbad\nb : x:y\na:2") == {"a": "2", "b": "x:y"}
    assert len(one(spark, X.middle_elided(t), t="z" * 500)) == 159
    assert one(spark, X.parameter_name(t, F.lit("e")), t="e.preventDefault(); x.e()") == "event" and one(spark, X.parameter_name(t, F.lit("q")), t="none") is None


def test_predicates(spark):
    t = F.col("t")
    for path, inside in (("a/b", True), ("a/../b", True), ("../a", False), ("a/../../b", False), ("/etc", False), ("C:\\x", False), ("", True)):
        assert one(spark, Q.inside_root(t), t=path) == inside, path
    for text, hint in (("lodash", True), ("abc", False), ("./local", False), ("12px", False), ("en-US", False), ("button", False), ("@scope/pkg", True)):
        assert one(spark, Q.package_hint(t), t=text) == hint, text
    gates = spark.createDataFrame([(6 << 20, False), (400 << 10, True), (400 << 10, False), (1, True)], "s long, i boolean")
    assert [r[0] for r in gates.select(Q.size_gate(F.col("s"), F.col("i"))).collect()] == ["preserve", "preserve", "risk", "transform"]
    files = spark.createDataFrame([("node_modules/a.js",), ("webpack/boot.js",)], "path string")
    assert [r.path for r in Q.own_files(files).collect()] == ["webpack/boot.js"]
    assert [r.path for r in Q.own_files(files.union(spark.createDataFrame([("src/a.js",)], "path string"))).collect()] == ["src/a.js"]
    plan = spark.createDataFrame([(0.9, "low", "own", 1), (0.9, "high", "own", 2), (0.5, "low", "own", 3), (0.95, "low", "recovered", 4), (0.8, "low", "own", 5)], "confidence double, risk string, scope string, id int")
    assert [r.id for r in Q.apply_gate(plan, 0.7, 1, [F.desc("confidence")]).collect()] == [1]
    assert one(spark, Q.search("ODA", t), t="Lodash is Soda") and one(spark, Q.runtime_path(t), t="a/vendor-x.js") and one(spark, Q.generated_metadata(t), t="x/_manifest.json")


def test_lines_and_prefixes(spark):
    files = spark.createDataFrame([("1", "a\n//# two\nb\nc"), ("2", "")], "file_id string, content string")
    assert sorted(map(tuple, lines.fragments(files, 3).collect())) == [("1", 0, 1, 3, 12), ("1", 1, 4, 4, 2), ("2", 0, 1, 1, 1)]
    assert sorted(map(tuple, lines.sections(files, "^//#").collect())) == [("1", 0, 1, 1), ("1", 1, 2, 3), ("2", 0, 1, 1)]
    groups = spark.createDataFrame([("k", 0, 3), ("k", 1, 50), ("k", 2, 4), ("k", 3, 60), ("k", 4, 1)], "key string, at int, n int")
    assert sorted(map(tuple, lines.merge_tiny(groups, ["key"], "at", "n", F.col("n") < 20).collect())) == [("k", 0, 3, 1), ("k", 1, 54, 2), ("k", 3, 61, 2)]
    paths = spark.createDataFrame([("g", "a/b/c.js", 1), ("g", "a/b/d/e.js", 2), ("h", "x.js", 4), ("i", "p/q/r.js", 8)], "g string, path string, n int")
    assert dict(map(tuple, lines.common_prefix(paths, ["g"], "path").collect())) == {"g": "a/b", "h": "", "i": "p/q"}
    kept = {r.prefix: r.bytes for r in lines.collapsed_prefixes(paths, "path", "n").collect()}
    assert kept == {"a": 3, "x.js": 4, "p": 8, "a/b/c.js": 1, "a/b/d": 2}


def test_references(spark):
    rows = [("a/x.js", "y.map", "c"), ("a/y.map", None, "m"), ("b/z.js", "deep/w.map", "c"), ("q/w.map", None, "m"), ("r.js", "data:,k", "c"), ("s.js", "//h/m.map", "c"), ("t.js", "gone.map", "c")]
    files = spark.createDataFrame(rows, "path string, reference string, content string")
    got = {r.path: (r.how, r.resolved) for r in resolve.resolved_references(files).collect()}
    assert got == {"a/x.js": ("path", "a/y.map"), "b/z.js": ("basename", "q/w.map"), "r.js": ("data", "data:,k"), "s.js": ("absolute", "//h/m.map"), "t.js": ("missing", None)}
    assert [tuple(r) for r in resolve.inline_maps(files).collect()] == [("r.js", "k")]
    head = spark.createDataFrame([({"x-sourcemap": "h.map"}, "//# sourceMappingURL=c.map"), ({}, "//# sourceMappingURL=c.map")], "h map<string,string>, c string")
    assert [r[0] for r in head.select(resolve.map_reference(F.col("h"), F.col("c"))).collect()] == ["h.map", "c.map"]
    assert one(spark, resolve.tolerant_json(F.col("t")).cast("string"), t='noise {"a":1} tail') == '{"a":1}' and one(spark, resolve.tolerant_json(F.col("t")).cast("string"), t="none") is None
    kinds = lambda names: sorted(tuple(r)[:2] for r in resolve.local_file_groups(spark.createDataFrame([(n,) for n in names], "path string")).collect())
    assert kinds(["a.js", "a.js.map", "b.map", "c.js"]) == [("pair", "a.js"), ("single", "b.map"), ("single", "c.js")]
    assert kinds(["a.js", "index.html"]) == [("snapshot", "a.js"), ("snapshot", "index.html")]
    need = spark.createDataFrame([("https://h/a.js", None, True), ("b.js", None, True), ("c.js", "x", False)], "path string, content string, missing_content boolean")
    fetched = spark.createDataFrame([("https://h/a.js", "body"), ("b.js", "no")], "url string, body string")
    assert {r.path: (r.content, r.missing_content) for r in resolve.with_fetched_content(need, fetched).collect()} == {"https://h/a.js": ("body", False), "b.js": (None, True), "c.js": ("x", False)}
    manifest = spark.createDataFrame([("d/_manifest.json", '{"parts":[{"file":"p1.js","lines":3},{"file":"p2.js","lines":1}]}')], "path string, content string")
    parts = resolve.manifest_parts(manifest, spark.createDataFrame([("d/p1.js", "t")], "path string, content string")).collect()
    assert sorted((r.chunk, r.file, r.lines, r.part_content) for r in parts) == [("d", "p1.js", 3, "t"), ("d", "p2.js", 1, None)]
