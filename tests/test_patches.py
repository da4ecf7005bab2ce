"""Balanced functions and patch plans on literal rows and against plain Python."""

import hashlib
import random

from sitelens.operators import patches


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def test_functions_are_closed_at_the_right_brace(spark):
    code = (
        "const handleMount = (editor, m = {}) => { const s = '}'; // }\n  if (/[}]/.test(`}${ { a: '}' } }`)) { addExtraLib(typesText); }\n}  ;\n"
        "export async function* outer(a) { function inner() { return {} } const f = async (x) => { inner() } }\nconst g = () => 1; o.function(a) ; let h = (a) => { unclosed"
    )
    files = spark.createDataFrame([("a", code), ("b", None), ("c", ""), ("d", "}{)(")], "file_id string, content string")
    rows = {r.name: r for r in patches.named_functions(files).collect()}
    assert set(rows) == {"handleMount", "outer", "inner", "f"}
    assert rows["handleMount"].text == code[: code.index("export")].rstrip("\n") and rows["handleMount"].depth == 0
    assert rows["inner"].text == "function inner() { return {} } " and rows["f"].text == "const f = async (x) => { inner() } " and rows["inner"].depth == rows["f"].depth == 1
    assert all(code[r.start : r.stop] == r.text and code[r.body_start - 1] == "{" and code[r.body_stop] == "}" for r in rows.values())
    payloads = spark.createDataFrame([("a", "typesText", []), ("a", "other", ["type-declaration"]), ("a", "none", ["size"]), ("b", "typesText", [])], "file_id string, symbol string, evidence array<string>")
    assert {(r.name, r.symbol) for r in patches.related_payloads(patches.named_functions(files), payloads).collect()} == {("handleMount", "typesText"), ("handleMount", "other")}
    assert patches.named_functions(files.filter("false")).count() == 0


def brute(actions, files):
    """Reasons, and the files after one action after the other from the end."""
    reasons, fits = {}, {}
    for name, source, before, mark, after in actions:
        if not source or not before or not mark:
            why = "missing-exact-before-or-hash"
        elif digest(before) != mark:
            why = "plan-before-hash-mismatch"
        elif source.startswith("src/recovered-entry/"):
            why = "generated-entry-locked"
        elif source not in files:
            why = "source-file-missing"
        else:
            text = files[source] or ""
            at = text.find(before)
            why = "exact-before-not-found" if at < 0 else "exact-before-not-unique" if text.find(before, at + len(before)) >= 0 else "missing-exact-after" if after is None else None
            if why is None:
                fits.setdefault(source, []).append((at, at + len(before), name, after))
        reasons[name] = why
    out = dict(files)
    for source, mine in fits.items():
        reach, kept = -1, []
        for at, end, name, after in sorted(mine):
            reasons[name] = "overlaps" if at < reach else None
            kept += [(at, end, after)] if at >= reach else []
            reach = max(reach, end)
        for at, end, after in reversed(kept):
            out[source] = out[source][:at] + after + out[source][end:]
    return reasons, out


def test_random_plans(spark):
    r = random.Random(12)
    files = {f"src/{k}.js": "".join(r.choice("abcé😀") for _ in range(r.randint(0, 40))) for k in range(60)} | {"src/recovered-entry/a.js": "abc", "src/null.js": None}
    actions = []
    for k in range(900):
        source = r.choice([*files, *files, "src/lost.js", None, ""])
        text = files.get(source) or "abc"
        at = r.randint(0, max(0, len(text) - 1))
        before = r.choice([None, "", "zz", *[text[at : at + r.randint(1, 6)]] * 9])
        mark = r.choice([None, "0", *[digest(before or "")] * 9])
        actions.append((f"{k:04}", source, before, mark, r.choice([None, "", "<>", "é"])))
    table = spark.createDataFrame([(n, "replace", s, b, m, a, None) for n, s, b, m, a in actions], "action_id string, type string, source_file string, before string, before_hash string, after string, symbol string")
    texts = spark.createDataFrame(list(files.items()), "path string, content string")
    reasons, out = brute(actions, files)
    judged = patches.judged_actions(table.repartition(5), texts, locked=True)
    assert {x.action_id: x.reason for x in judged.collect()} == reasons and len(set(reasons.values())) == 9
    assert {x.path: x.content for x in patches.patched(texts, judged).collect()} == out
    counts = {(x.status, x.reason): x.actions for x in patches.outcome_counts(judged).collect()}
    assert counts["applied", ""] == sum(v is None for v in reasons.values()) and sum(counts.values()) == len(actions)
    assert patches.judged_actions(table.filter("false"), texts).count() == 0 and patches.judged_actions(table, texts.filter("false")).filter("reason is null").count() == 0


def test_repeated_actions_count_once(spark):
    rows = [("2", "t", "f", "h"), ("1", "t", "f", "h"), ("3", "t", "f", "i"), ("4", "t", None, None), ("5", "t", "", "")]
    table = spark.createDataFrame([(a, t, s, h, None) for a, t, s, h in rows], "action_id string, type string, source_file string, before_hash string, symbol string")
    assert sorted(r.action_id for r in patches.distinct_actions(table).collect()) == ["1", "3", "4"]
