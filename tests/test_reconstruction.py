"""Manifests from competing claims, and plans met on spans, on literal rows."""

import itertools
import json

from sitelens.operators import planning, reconstruction

PROJECTS = "project string, label string, shared_root string, framework string, kind string, typescript boolean"
PACKAGES = "project string, name string, version string, requested array<string>, resolution string, confidence string"


def test_fields_by_precedence_and_conflicts(spark):
    root = {"name": " mine ", "version": "", "private": False, "dependencies": {"react": "*", "a": "1"}, "scripts": {"build": "own"}}
    below = {"name": "other", "version": "9", "dependencies": {"a": "2", "b": "3"}, "devDependencies": {"c": "1"}}
    files = [("p", "package.json", json.dumps(root)), ("p", "x/package.json", json.dumps(below)), ("p", "a.js", "{}"), ("q", "y/z/package.json", "{broken"), ("q", "long/er/package.json", "[1]"), ("r", "lib/package.json", json.dumps(below)), ("r", "lib/sub/package.json", json.dumps(below)), ("r", "b/not-package.json", "{}"), ("s", "package.json", None)]
    table = spark.createDataFrame(files, "project string, path string, content string")
    projects = spark.createDataFrame([("p", "L", "S", "react", "react-app", True), ("q", "", " ", "unknown", "npm-package", False), ("r", "L", "S", "react", "npm-package", True), ("s", "L", None, "unknown", "npm-package", False)], PROJECTS)
    packages = spark.createDataFrame([("p", "react", "18", None, "exact", "high"), ("p", "mine", "1", None, "exact", "high"), ("r", "react", None, ["17", "16"], "exact", "high"), ("r", "d", None, None, "exact", "medium"), ("r", "e", "1", None, "ecosystem", "high"), ("q", "f", "1", None, "exact", "low")], PACKAGES)
    got = {}
    for n in (1, 7):
        rows = reconstruction.reconstructed(reconstruction.claims(projects.repartition(n), table.repartition(n), packages.repartition(n))).collect()
        got[n] = {(r.project, r.section, r.name): (r.value, r.source, r.rivals) for r in rows}
        assert len(got[n]) == len(rows)
    one = got[1]
    assert one == got[7]
    assert one["p", "manifest", "name"] == ("mine", "recovered-manifest", 0) and one["p", "manifest", "version"] == ("0.0.0-recovered", "default", 0) and one["p", "manifest", "private"][0] == "false"
    assert one["p", "dependencies", "react"] == ("18", "package-evidence", 1) and one["p", "dependencies", "a"] == ("1", "recovered-manifest", 0) and one["p", "dependencies", "react-dom"] == ("*", "react-template", 0)
    assert one["p", "scripts", "build"] == ("own", "recovered-manifest", 1) and one["p", "scripts", "dev"][1] == "default" and ("p", "dependencies", "mine") not in one
    assert one["q", "manifest", "name"][0] == "recovered-package" and ("q", "dependencies", "f") not in one and one["q", "scripts", "build"][1] == "default"
    assert one["r", "manifest", "name"][0] == "other" and one["r", "peerDependencies", "react"] == ("17", "package-evidence", 0) and one["r", "dependencies", "d"][0] == "*" and ("r", "scripts", "build") not in one
    assert one["s", "manifest", "name"] == ("L", "default", 0)
    assert {tuple(r) for r in reconstruction.conflicts(table).collect()} == {("p", "dependencies", "a", "1", "package.json"), ("p", "dependencies", "a", "2", "x/package.json")}
    assert reconstruction.claims(projects.filter("false"), table, packages).count() == 0


def test_any_plans_may_be_absent(spark):
    parts = [("f", 1, 0, 10), ("f", 2, 10, 12), ("g", 3, 5, 6)]
    plans = {"a": [("f", 0), ("f", 9), ("f", 12), ("h", 1)], "b": [("f", 11), ("g", 5), ("g", 6)], "c": []}
    table = spark.createDataFrame(parts, "file_id string, part int, start int, stop int")
    for present in itertools.chain.from_iterable(itertools.combinations(plans, n) for n in (0, 1, 3)):
        given = {k: spark.createDataFrame(v, "file_id string, at int") if k in present else None for k, v in plans.items()}
        want = {(f, p): [True, 0, 0, 0] for f, p, *_ in parts}
        for k, name in enumerate(plans):
            for f, at in plans[name] if name in present else ():
                part = next((p for g, p, s, e in parts if g == f and s <= at < e), None)
                want.setdefault((f, part), [False, 0, 0, 0])[k + 1] += 1
        rows = planning.rolled_together(table, given).collect()
        assert {(r.file_id, r.part): [r.in_parts, r.n_a, r.n_b, r.n_c] for r in rows} == want
        assert all((r.has_a, r.has_b) == (r.n_a > 0, r.n_b > 0) for r in rows)
