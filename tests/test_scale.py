"""Steps that must hold at size: rows dealt to all cores, no broadcast of what grows, ties as in the SQL."""

import __spark_entry__ as entry
import duckdb
import pytest


def made(tmp_path, table, select):
    duckdb.connect().execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def held_against_sql(spark, name, folder, table):
    df = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    order = [c[0] for c in con.description]
    got = [tuple(r) for r in df.select(*order).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want
    return got


def test_pieces_that_overlap_their_own_repeat(spark, tmp_path):
    folder = made(tmp_path, "lineitem", "SELECT 1::BIGINT AS l_orderkey, 5::BIGINT AS l_partkey, CASE WHEN i = 1 THEN 2 ELSE 7 END::BIGINT AS l_suppkey, i::INT AS l_linenumber, 3.0 AS l_quantity, 1.0 AS l_extendedprice FROM range(1, 4) t(i)")
    got = held_against_sql(spark, "patch_actions", folder, "lineitem")
    assert [r[2] for r in got] == ["exact-before-not-unique"] * 3


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_bytes_of_parts_are_dealt_to_all_cores(spark, tiny):
    from sitelens.plans.generated import _parts

    assert _parts(spark, tiny).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["module_graph_summary", "module_edges", "called_sections", "webpack_edges", "module_importers", "bundle_breakdown", "lookup_original_position", "island_files", "bundle_roles", "missing_dynamic_imports"])
def test_what_grows_is_not_broadcast(spark, tiny, name):
    assert "BroadcastHashJoin" not in plan(entry.queries()[name](spark, tiny))


def test_edges_of_a_site_are_read_once(spark, tiny):
    from sitelens.plans.scripts import _links

    files, edges, _, _ = _links(spark, tiny)
    assert "MapInPandas" not in plan(edges) and "BroadcastHashJoin" not in plan(files) and edges.count()


def test_folds_take_columns_along(spark):
    from sitelens.operators import ranges

    rows = spark.createDataFrame([("a", 2, 60, "y"), ("a", 1, 150, "x"), (None, 1, None, "n"), ("a", 3, 150, None)], "g string, at int, size int, word string")
    got = ranges.fold_groups(rows, ["g"], ["at"], "size", ranges.greedy_bins(200), "bin", ["word"]).collect()
    assert {(r.g, r.at, r.bin, r.word) for r in got} == {("a", 1, 0, "x"), ("a", 2, 1, "y"), ("a", 3, 2, None), (None, 1, 0, "n")}


def test_members_of_webpack_tables_in_batches(spark):
    from sitelens.operators import webpack

    pack = "x({100:(e,t,r)=>{r(101)},101:(e,t,r)=>{r(100);r(101);r(999)}})"
    files = spark.range(6000).selectExpr("CAST(id AS STRING) AS file_id", f"IF(id % 3 = 0, NULL, '{pack}') AS content").repartition(1)
    found = webpack.modules(files)
    assert found.count() == 8000 and webpack.edges(found).count() == 8000


def test_intervals_stay_open_over_batches(spark):
    from sitelens.operators import ranges

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        points = spark.range(300).selectExpr("'f' AS f", "id AS at")
        stretches = spark.createDataFrame([("f", 0, 200, "out"), ("f", 50, 150, "in"), ("f", 60, 61, None), ("g", 0, 300, "other")], "f string, start long, stop long, name string")
        got = {r.at: r.name for r in ranges.innermost(points, stretches, ["f"], "at", "start", "stop", ["name"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: None if k == 60 or k >= 200 else "in" if 50 <= k < 150 else "out" for k in range(300)}


def test_names_are_planned_in_one_pass_over_files(spark, tiny):
    text = plan(entry.queries()["rename_plan"](spark, tiny))
    assert "Join" not in text and text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["scoped_aliases", "free_names"])
def test_scopes_are_settled_in_one_pass_over_files(spark, tiny, name):
    text = plan(entry.queries()[name](spark, tiny))
    assert "Join" not in text and "RDDScan" not in text and text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1


def test_tasks_grow_with_rows(spark):
    from sitelens.registry import spread

    assert spread(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100 and spread(spark.range(5), "id", 10).rdd.getNumPartitions() >= 8


def test_plain_code_is_cut_as_code_with_slashes():
    import random

    from sitelens.functions import tokens

    r = random.Random(5)
    for _ in range(400):
        code = "".join(r.choice(["a", "$b", " ", "\n", "1.5", ".", "?.", "...", "=>", "'x", '"y"', "\\", "{", "}", "(", ")", "// c\n", "/* d */", "é", "/*"]) for _ in range(r.randint(0, 14)))
        for comments in (False, True):
            assert list(tokens.tokens(code, comments)) == list(tokens._stateful(code, comments))


@pytest.mark.parametrize("name, step, most", [("page_islands", "&#x27;", 1), ("html_assets", "regexp_extract_all(", 13), ("css_props", "split(", 1)])
def test_what_a_page_declares_is_read_once(spark, tiny, name, step, most):
    text = entry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert 0 < text.count(step) - text.count("split(p_name") <= most


def test_attributes_of_odd_tags(spark):
    import random
    import re

    from pyspark.sql import functions as F
    from sitelens.functions import html

    r = random.Random(3)
    tags = ["".join(r.choice(["src", "SRC", "a", "=", " ", "\n", '"', "'", '"x y"', "'>'", "/", "é", "1"]) for _ in range(r.randint(0, 9))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(tags)), "k int, t string").select("k", html.attribute(F.col("t"), "src").alias("v"))
    met = lambda t: next((m[2] or m[3] or m[4] or "" for m in re.finditer(html._ATTRIBUTE, t) if m[1].lower() == "src"), None)
    got = {x.k: x.v for x in rows.collect()}
    assert got == {k: met(t) for k, t in enumerate(tags)} and len(set(got.values())) > 4


def test_maps_decoded_together_as_one_by_one(spark):
    import json
    import random

    from sitelens.sources import sourcemaps as V

    r = random.Random(11)
    coded = lambda: "".join(r.choice(["AAAA", "AACA", "CAAC", "DADD", "KAAAC", "A", "gB", "AAA", "ACAAD", "g", "", ",", ";", ";", ",", "!", "ggggggggggggggA"][: r.choice([8, 15, 17])]) for _ in range(r.randint(0, 12)))
    one = lambda: {"sources": [f"s{k}é" for k in range(r.randint(0, 4))], "names": ["n", "m"][: r.randint(0, 2)], "sourceRoot": r.choice(["", "r/"]), "mappings": ",".join(coded() for _ in range(r.randint(0, 3)))}
    texts = [json.dumps(one()) for _ in range(500)] + [json.dumps({"sections": [{"offset": {"line": 2, "column": 3}, "map": one()}]}) for _ in range(40)]
    texts += [None, "", "[]", '{"sources": ["a"], "mappings": "ggggggggggggggBAAA"}', "{", '{"sources": [null], "mappings": "AAAA"}', '{"sources": 5, "mappings": "AAAA"}', '{"sources": ["a"], "mappings": "A|A"}', '{"sources": ["a"], "mappings": "é"}']
    want = []
    for key, text in enumerate(texts):
        try:
            want += [x for x in V._rows(str(key), json.loads(text)) if x[2] < 1 << 63]  # larger numbers are broken
        except (TypeError, ValueError, KeyError, IndexError, AttributeError):
            pass
    got = V.mappings(spark.createDataFrame(list(enumerate(texts)), "map_id int, content string").repartition(3))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 500
    assert "MapInArrow" in plan(got)


def test_edges_of_modules_by_one_shuffle(spark, tiny):
    text = plan(entry.queries()["module_edges"](spark, tiny))
    assert "Join" not in text and text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("name", ["statement_modules", "missing_dynamic_imports"])
def test_statements_pass_as_arrow(spark, tiny, name):
    assert "MapInPandas" not in plan(entry.queries()[name](spark, tiny))


def test_blanks_before_patterns():
    from sitelens.operators import modules

    assert modules.blanked("x = \t/a;b/g; y / z; /* ; */ return /;/") == "x =        ; y / z;         return    "
    assert modules.blanked("f('a;') // ;\n`;\n;`") == "f(    )     \n  \n  "


@pytest.mark.parametrize("name", ["renamed_files", "spliced_files"])
def test_edits_come_with_their_files(spark, tiny, name):
    text = plan(entry.queries()[name](spark, tiny))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 1 and "MapInPandas" not in text


def test_scripts_in_rows_as_tables_of_edits(spark):
    import random

    from pyspark.sql import functions as F
    from sitelens.operators import edits

    r = random.Random(4)
    some = lambda: r.choice([None, -1, *range(14)])
    files = spark.createDataFrame([(str(k), r.choice([None, "", "abcdé😀ghijkl"])) for k in range(80)], "file_id string, content string")
    script = spark.createDataFrame([(str(r.randint(0, 70)), f"e{k}", some(), some(), r.choice([None, "", "<x>"])) for k in range(300)], edits.EDITS)
    judged = edits.checked(script, files)
    counts = judged.groupBy("file_id").agg(F.count_if(F.col("reason") == "overlaps").alias("overlapping"), F.count("reason").alias("refused"))
    want = edits.spliced(files, judged.filter("reason is null")).join(counts, "file_id", "left").fillna(0)
    rows = files.join(script.groupBy("file_id").agg(F.collect_list(F.struct("start", "stop", "edit_id", "replacement")).alias("script")), "file_id", "left")
    assert sorted(map(repr, map(tuple, edits.spliced_scripts(rows).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_renames_in_rows_as_tables_of_renames(spark):
    from pyspark.sql import functions as F
    from sitelens.operators import edits

    files = spark.createDataFrame([("f", "a.b(a, 'a', c) // a\na"), ("g", None), ("h", "x")], "file_id string, content string")
    asked = spark.createDataFrame([("f", "r1", "a", "new", 0.9, "low", None, 9), ("f", "r2", "a", "old", 0.9, "low", None, None), ("f", "r3", "c", "d", 0.9, "low", None, None), ("g", "r4", "a", "b", 0.9, "low", None, None)], "file_id string, rename_id string, symbol string, new_name string, confidence double, risk string, `from` long, upto long")
    changed, report = edits.applied_renames(files, asked)
    rows = files.join(asked.groupBy("file_id").agg(F.collect_list(F.struct("rename_id", "symbol", "new_name", "from", "upto")).alias("asked")), "file_id", "left")
    got = edits.renamed_texts(rows)
    assert sorted(map(repr, map(tuple, got.select("file_id", "content").collect()))) == sorted(map(repr, map(tuple, changed.collect())))
    assert {(x.file_id, *x.r) for x in got.select("file_id", F.explode("report").alias("r")).collect()} == set(map(tuple, report.collect()))


def test_letters_are_sought_once(spark, tiny):
    assert plan(entry.queries()["named_letters"](spark, tiny)).count("regexp_extract_all(") == 7


def test_only_the_wanted_of_statements_is_made(spark, tiny):
    from sitelens.operators import modules

    assert "uses#" not in plan(entry.queries()["missing_dynamic_imports"](spark, tiny))
    code = "import 'a';\nimport { b } from \"c\"; xfrom 'd';\nexport * from'e';\nconst f = import( './g' ), h = ximport('i');\nfunction j() {\n}\n"
    files = spark.createDataFrame([("1", code), ("2", None), ("3", " ;"), ("4", "k")], "file_id string, content string")
    every = sorted(modules.statements(files).collect())
    assert [r.imports for r in every] == [["a"], ["c"], [], ["e"], [], [], []] and every[4].dynamic_imports == ["./g"]
    for wanted in (("dynamic_imports",), ("file_id", "stmt", "kind", "uses"), ("module", "imports")):
        got = modules.statements(files, wanted)
        assert got.columns == list(wanted)
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in wanted) for r in every)


def test_modules_of_statements_leave_out_what_is_not_shown(spark, tiny):
    text = plan(entry.queries()["statement_modules"](spark, tiny))
    assert not any(f" {c}#" in text for c in ("uses", "module", "start", "size"))


def test_maps_are_written_in_one_pass(spark, tiny):
    text = plan(entry.queries()["encoded_mappings"](spark, tiny))
    assert "Join" not in text and text.count("Exchange") == 1 and text.count("MapInArrow") == 2
    text = plan(entry.queries()["line_maps"](spark, tiny))
    assert "Join" not in text and text.count("Exchange hashpartitioning(map_id") == 1


def test_texts_of_maps(spark, monkeypatch):
    import json

    import pyarrow as pa
    from sitelens.sources import sourcemaps as V

    one = [(1, 0, None, None, None, "alone"), (1, 5, "b", 1, 0, "n"), (1, 5, "a", 2, 0, None), (3, 2, "a", 1, 9, "n")]
    long = [(k, 3 * k, "s", k, 0, None) for k in range(1, 400)]
    rows = [(m, *r) for m, part in ((None, one), ("", one[3:]), ("é", long), ("z", one[::-1])) for r in part]
    # Sources and names are listed by first place and value: a, b; alone, n.
    want = {None: (["a", "b"], ["alone", "n"], "A,KACA,ACDAC;;EDASA"), "": (["a"], ["n"], ";;EAASA"), "z": (["a", "b"], ["alone", "n"], "A,KACA,ACDAC;;EDASA")}
    found = spark.createDataFrame(rows, V.MAPPINGS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for df in (V.encoded_maps(found.repartition(5)), V.encoded_maps(found.coalesce(1), dealt=True)):
            texts = {r.map_id: r.content for r in df.collect()}
            assert texts.keys() == {None, "", "é", "z"}
            for key, (sources, names, mapped) in want.items():
                assert json.loads(texts[key]) == {"version": 3, "sources": sources, "names": names, "mappings": mapped}
            assert sorted(V.mappings(df.filter("map_id = 'é'")).collect()) == sorted(("é", *r) for r in long)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    columns = [pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(zip(*rows), (c.split() for c in V.MAPPINGS.split(", ")))]
    batch = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in V.MAPPINGS.split(", ")])
    whole = [r for b in V._written(batch) for r in b.to_pylist()]
    monkeypatch.setattr(V, "MOST_TEXT", 10)
    parts = list(V._written(batch))
    assert len(parts) == 4 and [r for b in parts for r in b.to_pylist()] == whole
    with pytest.raises(OverflowError):
        list(V._written(pa.RecordBatch.from_arrays([pa.array([2**62]) if k == 2 else c[:1] for k, c in enumerate(columns)], names=batch.schema.names)))


def test_edits_are_held_together_as_arrays(spark):
    from pyspark.sql import functions as F
    from sitelens.operators import edits

    rows = [("a", "abcdef", [(4, 5, "z", "<4>"), (0, 2, "y", "<0>"), (1, 3, "x", "<1>"), (2, 2, "w", None), (2, 3, "v", "<2>")]), ("b", None, [(0, 0, "e", "new"), (0, 1, "f", "far")]), ("c", "left", []), ("d", "left", None), ("e", "xy", [(None, 1, "g", "n"), (2, 2, "h", "!")])]
    files = spark.createDataFrame(rows, "file_id string, content string, script array<struct<start:int,stop:int,edit_id:string,replacement:string>>").coalesce(1)
    got = edits.spliced_scripts(files)
    assert "sort_array(" in plan(got)
    assert sorted(map(tuple, got.collect())) == [("a", "<0>cd<4>f", 2, 3), ("b", "new", 0, 1), ("c", "left", 0, 0), ("d", "left", 0, 0), ("e", "xy!", 0, 1)]
    assert edits.spliced_scripts(files.filter(F.lit(False))).count() == 0
