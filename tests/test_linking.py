"""Components, levels, bundles, merged evidence and map texts against plain Python."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.operators import evidence, linking
from sitelens.sources import sourcemaps


def reach(node, edges):
    seen, left = {node}, [node]
    while left:
        n = left.pop()
        for a, b in edges:
            if a == n and b not in seen:
                seen.add(b)
                left.append(b)
    return seen


def brute(nodes, edges):
    edges = {(a, b) for a, b in edges if a in nodes and b in nodes}
    whole = {n: reach(n, edges) for n in nodes}
    component = {n: max(m for m in whole[n] if n in whole[m]) for n in nodes}
    level = lambda c: max((1 + level(component[b]) for a, b in edges if component[a] == c and component[b] != c), default=0)
    return {(n, component[n], level(component[n])) for n in nodes}


def test_components_and_levels(spark):
    r = random.Random(2)
    nodes = [f"n{k:02}" for k in range(45)]
    edges = [(r.choice(nodes[:30]), r.choice(nodes[:30])) for _ in range(34)] + [(nodes[k], nodes[k + 1]) for k in range(30, 38)] + [(nodes[35], nodes[31])]
    edges += [(nodes[3], nodes[3]), (nodes[3], "no node"), ("no node", nodes[4])] + edges[:4]
    n, e = spark.createDataFrame([(x,) for x in [*nodes, nodes[0], None]], "node string"), spark.createDataFrame([*edges, (None, "n01")], "src string, dst string")
    assert {tuple(x) for x in linking.levels(n, e).collect()} == brute(set(nodes), edges)
    assert linking.levels(n.filter("false"), e).count() == 0 and linking.components(n, e.filter("false")).filter("node = component").count() == len(nodes)


def test_bundles_and_missing_parts(spark):
    files = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None), ("d", "D"), ("lone", "L")], "path string, content string")
    assets = spark.createDataFrame([("a", "other"), ("x", "X"), ("page", "<!DOCTYPE html>")], "path string, content string")
    links = [("a", "b", False), ("b", "c", True), ("c", "b", False), ("c", "d", True), ("d", "x", True), ("x", "gone", True), ("d", "page", True), ("d", "stub", True), ("d", "npm", False)]
    edges = spark.createDataFrame(links, "src string, dst string, dynamic boolean")
    entries = spark.createDataFrame([("a",), ("lone",), ("nowhere",)], "entry string")
    whole = linking.available(files, assets)
    assert {(r.path, r.origin) for r in whole.collect()} == {(p, "part") for p in ("a", "b", "c", "d", "lone")} | {("x", "asset")}
    assert {tuple(r) for r in linking.bundles(whole, edges, entries).collect()} == {("a", "X\nD\nB\n\nA", "x,d,b,c,a"), ("lone", "L", "lone")}
    stubs = spark.createDataFrame([("stub",)], "path string")
    assert {tuple(r) for r in linking.missing(whole, edges, entries, stubs).collect()} == {("a", "gone", "x"), ("a", "page", "d"), ("nowhere", "nowhere", None)}


def merge(items):
    out = {}
    for name, version, kind, detail, file, _ in sorted((i for i in items if i[0]), key=lambda i: i[5]):
        d = out.setdefault(name, ["*", detail or "package evidence", []])
        if d[0] == "*" and version:
            d[0] = version
        one = (kind or "fingerprint", detail or "", file or None, version or None)
        if one not in d[2]:
            d[2].append(one)
    return {(n, v, e, tuple(found[:20]), len(found)) for n, (v, e, found) in out.items()}


def test_merged_dependencies_whatever_the_partitions(spark):
    r = random.Random(7)
    pick = lambda *x: r.choice(x)
    items = [(pick("a", "a", "a", "b", "c", "", None), pick(None, "", "*", "1", "2", "3"), pick("m", "n", None, ""), pick("", None, "d", "e", "f", "g"), pick("p", "q", "s", None), k) for k in range(600)]
    items.append(("once", None, None, None, None, 9999))
    table = spark.createDataFrame(items, "name string, version string, type string, detail string, file string, position long")
    want = merge(items)
    for n in (1, 4, 16):
        got = evidence.merged_dependencies(table.repartition(n)).collect()
        assert {(x.name, x.version, x.evidence, tuple(tuple(i) for i in x["items"]), x.n_items) for x in got} == want
    assert evidence.merged_dependencies(table.filter("false")).count() == 0


def test_compacted_evidence_whatever_the_partitions(spark):
    r = random.Random(8)
    items = [(r.choice(["a", "b", None]), f"f{r.randint(0, 5)}", r.choice([None, "", "1", "2"]), r.choice("xyz"), r.choice([None, 0, 1, 4]), k) for k in range(400)]
    table = spark.createDataFrame(items, "package string, file string, version string, type string, weight long, position long")
    places = {}
    for package, file, version, kind, weight, at in items:
        if package:
            p = places.setdefault((package, file, version or ""), [[], 0, at])
            p[0] += [kind] * (kind not in p[0])
            p[1] += weight or 1
    want = set()
    for package in "ab":
        mine = sorted(((k, v) for k, v in places.items() if k[0] == package), key=lambda x: (-x[1][1], x[1][2]))
        want |= {(*k, "+".join(v[0]), v[1], n + 1) for n, (k, v) in enumerate(mine[:12])}
    for n in (1, 16):
        assert {tuple(x) for x in evidence.compacted_evidence(table.repartition(n)).collect()} == want
    totals = {p: round(sum(v[1] for k, v in places.items() if k[0] == p)) for p in "ab"}
    got = evidence.vendor_candidates(table).collect()
    assert {x.package: x.confidence for x in got} == totals and all(x.places == 12 for x in got) and [sorted(x.versions.split(",")) for x in got] == [["1", "2"]] * 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40) | st.integers(-40, 40), min_size=1, max_size=60))
def test_numbers_come_back(spark, numbers):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(numbers)], "k int, n long").select("k", sourcemaps.encoded_vlq(F.col("n")).alias("text"))
    assert [sourcemaps.vlq(r.text) for r in rows.orderBy("k").collect()] == [[n] for n in numbers]


def test_map_texts_hold_random_mappings(spark):
    r = random.Random(11)
    rows = []
    for m in range(20):
        for _ in range(r.randint(1, 80)):
            bare = r.random() < 0.2
            where = (None, None, None, None) if bare else (f"s{r.randint(0, 3)} é\"", r.randint(1, 5000), r.randint(0, 300), r.choice([None, "n1", "n\\2", "ñ"]))
            rows.append((str(m), r.choice([1, 2, 7, r.randint(1, 400)]), r.randint(0, 2000), *where))
    found = spark.createDataFrame(rows, sourcemaps.MAPPINGS)
    back = sourcemaps.mappings(sourcemaps.encoded_maps(found.repartition(6)))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sourcemaps.encoded_maps(found.filter("false")).count() == 0


def test_line_to_line_maps(spark):
    files = spark.createDataFrame([("one", "a.js", "x", "a\nb\nc"), ("some", "b.js", "x\ny", "a\nb\nc\n"), ("none", "c.js", None, None)], "map_id string, path string, original string, transformed string")
    maps = sourcemaps.encoded_maps(sourcemaps.line_mappings(files)).select("map_id", F.get_json_object("content", "$.mappings"))
    assert dict(map(tuple, maps.collect())) == {"one": "AAAA;AAAA;AAAA", "some": "AAAA;AACA", "none": "AAAA"}
