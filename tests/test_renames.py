"""Rename plans and vendor rules against plain Python."""

import random

from pyspark.sql import functions as F

from sitelens.functions import short_names
from sitelens.operators import edits, renames, scopes, vendors


def program(seed):
    r = random.Random(seed)
    lines = []

    def body(names, depth):
        for _ in range(r.randint(1, 4)):
            if depth < 3 and r.random() < 0.4:
                inner = r.sample("abcdx", r.randint(1, 2))
                head = r.choice(["function {}({}) {{", "const {} = ({}) => {{"])
                lines.append(head.format(r.choice(["isReady", "parseError", "mergeArray", "drawShape", "format"]) + str(len(lines)), ", ".join(inner)))
                body(names + inner, depth + 1)
                lines.append("}")
            else:
                lines.append(f"use({', '.join(r.choice([*names, 'value', 'items', 'error', 'free']) for _ in range(3))}, 'a');")

    body([], 0)
    return "\n".join(lines)


def test_plans_keep_every_binding(spark):
    files = spark.createDataFrame([(str(k), program(k)) for k in range(120)] + [("null", None), ("empty", "")], "file_id string, content string")
    plan = renames.rename_plan(files.repartition(5))
    rows = plan.collect()
    assert len(rows) > 150 and any(x.new_name != x.suggested for x in rows) and {x.risk for x in rows} == {"low", "medium", "high"}
    judged = edits.checked(renames_edits := edits.rename_edits(files, plan), files)
    changed = edits.spliced(files, judged.filter("reason is null"))
    assert renames_edits.count() > len(rows) and judged.filter("reason is not null").count() == 0

    def bindings(table):
        found = scopes.aliases(table).collect()
        return [(x.file_id, x.kind, x.line, x.references) for x in sorted(found, key=lambda x: (x.file_id, x.line, x.column))]

    assert bindings(changed) == bindings(files)
    assert sorted(map(tuple, scopes.free_names(changed).collect())) == sorted(map(tuple, scopes.free_names(files).collect()))


def test_rules_and_refusals(spark):
    code = "function isCallback(a) { callback() }\nfunction navigateTo(a, b) { navigate(a, b) }\nfunction doLogout(a) { a().catch(b) }\nconst go = (a) => { }\nfunction toPath(a, value) { const toPath = a }\nfunction switch1(aa, a$) { }\nfunction parseError({ a }, b, c = 1) { b }"
    files = spark.createDataFrame([("f", code)], "file_id string, content string")
    rows = {(x.function, x.symbol): (x.suggested, x.confidence, x.risk, x.new_name) for x in renames.rename_plan(files).collect()}
    assert rows["isCallback", "a"] == ("callback", 0.9, "low", "callback2")
    assert rows["navigateTo", "b"] == ("navigate", 0.86, "low", "navigate2") and rows["navigateTo", "a"][0:2] == ("navigate", 0.62)
    assert rows["doLogout", "a"] == ("logout", 0.9, "low", "logout") and ("go", "a") not in rows
    assert ("toPath", "a") not in rows and rows["switch1", "a$"][:2] == ("switch1", 0.58) and rows["switch1", "aa"][3] == "switch12"
    assert rows["parseError", "b"] == ("error", 0.62, "high", "error") and ("parseError", "c") not in rows


def test_longest_beginnings(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab/é") for _ in range(r.randint(0, n)))
    rules = sorted({(word(4), r.random() < 0.3) for _ in range(40)} - {("", True), ("", False)})
    rules = [(t, w) for t, w in rules if sum(t == o for o, _ in rules) == 1]
    names = [word(7) for _ in range(400)] + [None, "", "ab", "ab"]
    got = vendors.longest_beginning(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "package string, k int").repartition(4), "package", spark.createDataFrame(rules, "rule string, whole boolean"))
    want = {k: max((t for t, w in rules if n is not None and (n == t if w else n.startswith(t))), key=len, default=None) for k, n in enumerate(names)}
    assert {x.k: x.rule for x in got.collect()} == want and len(set(want.values())) > 10
    none = spark.createDataFrame([], "rule string, whole boolean")
    assert vendors.longest_beginning(got.drop("rule"), "package", none).filter("rule is not null").count() == 0


def test_letters_get_names_where_these_are_free(spark):
    cases = [
        ("e.target; e.x; be.e", "event.target; event.x; be.event"),
        ("e.target; r.json(); e.querySelector()", "event.target; response.json(); event.querySelector()"),
        ("e.target; f.pageX", "event.target; f.pageX"),
        ("d.body; let document", "d.body; let document"),
        ("x.on('a'); y.onclick = function (k) { k }", "x.on('a'); y.onclick = function (event) { event }"),
        ("e.key; try {} catch (e) { e.stack }", "error.key; try {} catch (error) { error.stack }"),
        ("", ""),
        (None, None),
    ]
    rows = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, code string")
    got = {r.k: r.new for r in rows.select("k", short_names.with_letter_names(F.col("code"), short_names.letter_names(F.col("code"))).alias("new")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_aliases_are_inlined_and_calls_unwrapped(spark):
    cases = [("var a = (1, 2);\nuse(a);", "\nuse((1, 2));"), ("var a = 1;\na + a", "var a = 1;\na + a"), ("var b = '$1\\\\';\nf(b)", "\nf('$1\\\\')"), ("x", "x")]
    rows = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], "k int, code string")
    got = {r.k: r.new for r in rows.select("k", short_names.inlined(F.col("code"), short_names.single_use_aliases(F.col("code"))).alias("new")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]
    whole = spark.createDataFrame([("(() => { a; { b } })();",), ("(function () {c})()\n",), ("(() => {})",)], "code string")
    assert [r[0] for r in whole.select(short_names.unwrapped(F.col("code"))).collect()] == [" a; { b } ", "c", "(() => {})"]
