"""Scores, roles and boundaries on literal rows, nulls and empty tables included."""

from sitelens.functions import html
from sitelens.operators import planning


def test_readiness_and_promotion_of_nulls(spark):
    schema = "file string, lines long, semantic boolean, fragment boolean, runnable boolean, candidate boolean, declarations int, exports int, runtime string, embedded boolean"
    rows = [(None,) * 10, ("exports.js", 100, True, False, True, True, 3, 50, None, False), ("w.js", 20000, False, True, False, False, 0, 0, "wasm-runtime", True)]
    got = [(r.readiness, r.label) for r in planning.readiness(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(0.46, "preserve-first"), (0.95, "source-like"), (0.05, "preserve-first")]
    schema = "file string, lines long, kind string, exports int, declarations int, imports int, globals int, externals int, runtimes int"
    rows = [(None,) * 9, ("a/exports.js", 50, "runtime-wrapper", 1, 0, 0, 0, 40, 0), ("m.js", 100, "source-candidate", 2, 5, 1, 0, 0, 0), ("g.js", 100, "source-candidate", 0, 9, 0, 1, 0, 0), ("i.js", 9000, "inspection-only", 9, 9, 9, None, None, None)]
    got = [(r.score, r.action) for r in planning.promotion(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(0, "inspect-only"), (38, "create-runtime-export-facade"), (100 + 13, "extract-module"), (48, "create-scope-wrapper"), (8, "inspect-only")]


def test_structure_and_ownership_of_nulls(spark):
    schema = "file string, entry string, names array<string>, signals array<struct<id: string, role: string, category: string>>, fragment boolean, runnable boolean"
    rows = [(None, None, None, None, None, None), ("a.js", None, ["x"], [], False, None), ("a/react.js", "e", [], [("webpack-runtime", "bundler-runtime", "bundler-runtime")], None, True), ("b.js", None, None, [("monaco-editor", "editor-runtime", "editor-runtime")], True, True)]
    parts = planning.ownership(planning.structure(spark.createDataFrame(rows, schema)))
    assert [(r.bucket, r.owner) for r in parts.collect()] == [
        ("src/app", "unknown/app-candidate"), ("src/app", "unknown/app-candidate"), ("src/vendor-boundaries", "runtime-signaled code"), ("src/compiler-runtime", "inspection-only runtime/vendor fragment"),
    ]


def test_boundaries_roles_and_contracts_of_empty_tables(spark):
    assets = spark.createDataFrame([], "asset string, package string, score double")
    rows = planning.package_boundaries(assets, spark.createDataFrame([("react",), (None,)], "name string")).orderBy("position").collect()
    assert len(rows) == len(planning.PACKAGES) - 1 and rows[0].deps == ["react"] and {r.assets for r in rows} == {0}
    files = spark.createDataFrame([("f", "/a.js"), ("g", None)], "file_id string, path string")
    pages = spark.createDataFrame([(1, '<script src="a.js"></script><script src="/a.js"></script>'), (2, None)], "page_id int, html string")
    assert {r.file_id: (r.role, r.pages) for r in planning.bundle_roles(files, pages).collect()} == {"f": ("page-script", 1), "g": ("unknown", 0)}
    mixed = spark.createDataFrame([("x/m.wasm", None), ("y/public/m.wasm", None), ("l.js", 'fetch("m.wasm"); fetch("n.wasm")'), ("k.js", None)], "path string, content string")
    assert [(r.wasm, r.file, r.specificity) for r in planning.wasm_contracts(mixed).collect()] == [("y/public/m.wasm", "l.js", 4)]


def test_layout_packets_and_audit_of_odd_tables(spark):
    pages = spark.createDataFrame([("b/index.html", "<html>"), ("a/index.html", None), ("z.html", "<head>x</head>")], "path string, content string")
    (row,) = html.layout_parts(pages).collect()
    assert (row.head, row.navigation, row.footer, row.fonts, row.integrations) == ("", None, None, [], [])
    assert html.layout_parts(pages.filter("path = 'z.html'")).count() == 0
    schema = "file string, at int, first_line int, last_line int, declarations array<string>, externals array<string>"
    rows = spark.createDataFrame([("Tree.js", 2, 5, 9, ["isOpen", "Tree"], None), ("Tree.js", 1, None, None, ["getX", "isOpen"], ["React", "useState"]), ("x.js", 1, 1, 2, None, None), (None, 1, 1, 2, ["treeLike"], [])], schema)
    got = {r.file: (r.first_line, r.last_line, r.helpers, r.components, r.kept) for r in planning.focus_packets(rows, "TREE").collect()}
    assert got == {"Tree.js": (5, 9, ["getX", "isOpen"], ["Tree"], ["React"]), None: (1, 2, [], [], [])}
    schema = "output string, lines int, candidate boolean, fragment boolean, exports int"
    tiny = spark.createDataFrame([("o", 1, True, None, None)] * 60 + [("o", None, None, None, None)] * 60 + [(None, 5, False, True, 1)], schema)
    assert [(r.code, r.n) for r in planning.audit(tiny).collect()] == [("preserved-runtime-fragments", 1), ("many-tiny-helper-modules", 1)]
    assert planning.audit(tiny.limit(0)).count() == 0
