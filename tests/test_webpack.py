"""Module tables of bundlers, sub-sections and rebuilt paths on small literal rows, odd ones included."""

from pyspark.sql import functions as F

from sitelens.functions import text
from sitelens.operators import iife, lines, modules, scoring, webpack
from sitelens.sources import resolve

from .test_operators import one

TABLE = """(()=>{var o={101:(e,t,r)=>{r.d(t,{a:()=>x});var x=r(202),y=r(7),s="r(303)"},"202":function(e,t,n){/* n(101) */ n(101);n(202)},303(e,t,q){q(101)},n:{a:1,b:2}},c={};function q(r){return o[r](c)}q(101)})()"""


def test_tables_are_told_from_other_objects():
    assert [f[0] for f in webpack.factories(TABLE)] == ["101", "202", "303"]
    assert webpack.factories("var a={1:2,3:4},b=[function(){},1,2,3],c={x:function(){},y:function(){}}") == []
    assert [f[0] for f in webpack.factories("f([function(e){},,function(e){}, 0])")] == ["0", "2"]
    for odd in ("", "{", "}}}", "[(((", "var s='{1:function(){}'"):
        assert webpack.factories(odd) == []
    deep = "{1:function(e){},2:function(e){" * 300 + "}}" * 300
    assert [f[0] for f in webpack.factories(f"x={deep}")] == ["1", "2"]


def test_requires_edges_and_remainder(spark):
    twice = "x({5:(e,t,r)=>{r(500)},500:function(){},500:(e,t,r)=>{r(500)}})"
    files = spark.createDataFrame([("a", TABLE), ("b", twice), ("c", None), ("d", "plain()")], "file_id string, content string")
    found = webpack.modules(files)
    rows = {(r.file_id, r.at): (r.module, r.requires, r.exports, r.score) for r in found.collect()}
    assert rows["a", 0] == ("101", ["202"], ["a"], 0.8) and rows["a", 1][:2] == ("202", ["101", "202"]) and rows["a", 2][:2] == ("303", ["101"])
    assert sorted(map(tuple, webpack.edges(found).collect())) == [("a", "101", "202"), ("a", "202", "101"), ("a", "303", "101"), ("b", "5", "500")]
    assert {(r.module, r.importers) for r in webpack.importers(found).filter("file_id = 'a'").collect()} == {("202", 1), ("101", 2)}
    rest = sorted((r.start, r.end) for r in webpack.remainder(files, found).filter("file_id = 'a'").collect())
    spans = [(r.start, r.start + r.size) for r in found.filter("file_id = 'a'").collect()]
    assert "".join(TABLE[a:b] for a, b in sorted(rest + spans)) == TABLE and rest[0][0] == 0 and rest[-1][1] == len(TABLE)


def test_remainder_of_accented_text(spark):
    code = "é('ñandú');x({100:(e,t,r)=>{'é😀'},200:function(){return/* ü */'ß'},300:function(){}})//é"
    files = spark.createDataFrame([("a", code)], "file_id string, content string")
    found = webpack.modules(files)
    rest = [(r.start, r.end) for r in webpack.remainder(files, found).collect()]
    spans = [(r.start, r.stop) for r in found.collect()]
    assert "".join(code[a:b] for a, b in sorted(rest + spans)) == code and len(spans) == 3 and len(rest) == 4


def test_regular_expressions_are_no_code():
    code = "a = /\"/; b = x / y / z; f(/[/']/g, '`'); return /{/"
    plain = modules.blanked(code)
    assert len(plain) == len(code) and "{" not in plain and '"' not in plain and "x / y / z" in plain and plain.count(";") == 3
    code = "a = /}/\nfunction f() {\n  g({\n  })\n}\n\nlet b = 1;c"
    spans = [code[a:b] for a, b in modules.statement_spans(modules.blanked(code))]
    assert spans == ["a = /}/\nfunction f() {\n  g({\n  })\n}\n", "\nlet b = 1;", "c"]


def test_statements_take_linear_time():
    import time

    def took(lines):
        code = "!function(){\n" + "a(b);\n" * lines + "}()"
        began = time.process_time()
        assert len(list(modules.statement_spans(code))) == 1 and iife.spans(code, 0, len(code))
        return time.process_time() - began

    took(1000)
    assert took(160_000) < 40 * took(10_000) + 0.5


def test_sub_sections_and_fragments(spark):
    code = "\n".join(["a();"] * 5 + ["}", "function f() {", "}", "", "function g() {"] + ["b();"] * 4)
    files = spark.createDataFrame([("x", code), ("y", ""), ("z", None)], "file_id string, content string")
    assert sorted(map(tuple, lines.sub_sections(files, "^function ", 3).collect())) == [("x", 0, 1, 6), ("x", 1, 7, 9), ("x", 2, 10, 14), ("y", 0, 1, 1)]
    assert sorted(map(tuple, lines.bounded_fragments(files, 6, 1000).collect())) == [("x", 0, 1, 6), ("x", 1, 7, 12), ("x", 2, 13, 14), ("y", 0, 1, 1)]
    assert lines.bounded_fragments(files, 100, 10).filter("file_id = 'x'").count() > 5


def test_rebuilt_paths_and_hints(spark):
    paths = ["site/index.js", "site/a", "site/a.js", "site/dist/b.css", "site/lib/c.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.output for r in resolve.output_paths(rows).collect()} == {"site/index.js": "src/index.js", "site/a": "src/a.js", "site/a.js": "src/a-2.js", "site/dist/b.css": "recovered/dist/b.css", "site/lib/c.ts": "lib/c.ts"}
    mixed = spark.createDataFrame([("index.html",), ("src/x.js",)], "path string")
    assert {r.output for r in resolve.output_paths(mixed).collect()} == {"recovered/index.html", "src/x.js"}
    p = F.col("p")
    for source, target, want in (("a/b/c.js", "a/d.js", "../d.js"), ("a.js", "b/c.js", "./b/c.js"), ("a/b.js", "a/c.js", "./c.js"), ("x/y/z.js", "a/z.js", "../../a/z.js")):
        assert one(spark, resolve.relative_specifier(p, F.lit(target)), p=source) == want
    assert one(spark, resolve.placeholder(p), p="a.html").startswith("<!-- Recovered path a.html,") and one(spark, resolve.placeholder(p), p="x").startswith("// ")
    assert one(spark, scoring.vendor_of(p), p="require_react_dom") == "react-dom" and one(spark, scoring.vendor_of(p), p="require_reactive") is None
    assert one(spark, text.export_hints(F.array(p)), p="ThemeStore") == ["state", "app-shell"] and one(spark, text.export_hints(F.array(p)), p="") == []


def test_sections_of_a_called_function(spark):
    code = "\n".join(["!function(){", "var a=1,b=2;", "var E=Object.freeze({A:1});", "(function(){", "class X{m(){return 1}}class Y{}", "var Z=X;", "function g(){}", "function h(){", *["x();"] * 12, "}", "Object.freeze(q);", "if(x){y()}", "return 5", "}());", "z();", "w();", "u();", "t()", "}();"])
    assert [code[a:b].strip()[:8] for a, b in iife.body_spans(iife.blanked(code))] == ["class X{", "class Y{", "var Z=X;", "function", "function", "Object.f", "if(x){y(", "return 5"]
    files = spark.createDataFrame([("a", code), ("b", None), ("c", ""), ("d", "plain(); var q = 1")], "file_id string, content string")
    types = [(r.type, r.name) for r in iife.items(files).filter("file_id = 'a'").orderBy("at").collect()]
    assert types == [("class", "X"), ("class", "Y"), ("alias", "Z"), ("function", "g"), ("function", "h"), ("enum", None), ("other", None), ("return", None)]
    got = [(r.section, r.category, r.statements, r.lines) for r in iife.sections(files).filter("file_id = 'a'").orderBy("section").collect()]
    assert got == [(0, "class", 3, 3), (1, "function", 5, 18)]
    assert {r.file_id for r in iife.sections(files).collect()} == {"a", "d"}
    units = spark.createDataFrame([("u", "\n".join(f"class C{k} {{\n{'x' * 3}\n}}" for k in range(10)))], "file_id string, content string")
    assert [r.lines for r in iife.sections(units, 7).orderBy("section").collect()] == [6] * 5
