"""Tokens, scopes and edit scripts against generated programs and plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelens.functions.tokens import plain, tokens
from sitelens.operators import edits, scopes
from sitelens.operators.ranges import innermost


def test_tokens_tell_literals_apart():
    code = "a = b / c / d; e = /[/\"]'/g.test(`x ${ f(`in ${g}`) + '}' } y`); // h / i\nif (j) /k/.k; return /l/ /* m */ + 'n\\'o'"
    kinds = [(k, t) for k, t, _ in tokens(code)]
    assert [t for k, t in kinds if k == "name"] == ["a", "b", "c", "d", "e", "test", "f", "g", "if", "j", "k", "return"]
    assert ("string", "/[/\"]'/g") in kinds and ("string", "/l/") in kinds and ("string", "'n\\'o'") in kinds
    assert all(code.startswith(t, at) for _, t, at in tokens(code, comments=True))
    assert len(plain(code)) == len(code) and "h" not in plain(code) and "o" not in plain(code) and plain(code).count("/") == 2


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["`", "${", "}", "{", "'", '"', "/", "//", "/*", "*/", "\\", "\n", "a", "1", " ", "(", ")", "=", "é"]), max_size=30).map("".join))
def test_tokens_cover_any_text(code):
    at = 0
    for _, text, start in tokens(code, comments=True):
        assert start >= at and code[at:start].strip() == "" and code.startswith(text, start)
        at = start + len(text)
    assert len(plain(code)) == len(code)
    scopes._parse(code)


class Program:
    """A random program, and what every name in it belongs to: bindings are [name, kind, line, references]."""

    def __init__(self, seed):
        self.r, self.lines, self.bindings, self.free = random.Random(seed), [], [], {}
        self.chain = [("function", {})]
        self.block(0)

    def bind(self, name, kind, at=-1):
        known = self.chain[at][1]
        if name in known:
            known[name][3] += 1
        else:
            known[name] = [name, kind, len(self.lines) + 1, 0]
            self.bindings.append(known[name])

    def say(self, text):
        self.lines.append(text)

    def use(self):
        name = self.r.choice("abcdef")
        self.pending.append(name)
        return self.r.choice([f"{name}", f"o.{self.r.choice('abc')} + {name}", f"`a ${{{name}}} b`", f"{{ {self.r.choice('abc')}: {name} }}", f"/a/.x + {name}", f"({name}, 'a')"])

    def settle(self, deferred):
        """Uses see all declarations of their scopes, later ones too."""
        for name, chain in deferred:
            found = next((s[name] for _, s in reversed(chain) if name in s), None)
            if found:
                found[3] += 1
            else:
                self.free[name] = self.free.get(name, 0) + 1

    def block(self, depth):
        deferred = []
        for _ in range(self.r.randint(1, 5)):
            self.pending = []
            r, name = self.r, self.r.choice("abcdef")
            kind = r.choice(["use", "use", "let", "var", "function", "arrow", "block", "catch", "for", "class", "method", "pattern"] if depth < 4 else ["use", "let", "var"])
            lexical = name not in self.chain[-1][1]  # the language forbids to declare it twice
            outer = max(k for k, (t, _) in enumerate(self.chain) if t == "function")
            if kind == "use":
                self.say(f"log = {self.use()};")
                self.pending.append("log")
            elif kind == "let" and lexical:
                self.bind(name, "let")
                self.say(f"let {name} = {self.use()};")
            elif kind == "var" and all(name not in s for _, s in self.chain[outer + 1 :]) and self.chain[outer][1].get(name, ["", "var"])[1] in ("var", "param", "function"):
                self.bind(name, "var", outer)
                self.say(f"var {name} = {self.use()};")
            elif kind == "pattern" and lexical:
                self.bind(name, "const")
                self.say(f"const {{ {r.choice('abc')}: [{name}] = {self.use()} }} = [];")
            elif kind in ("function", "arrow", "method"):
                if kind == "function":
                    self.bind("f" + name, "function", outer)
                scope = ("function", {})
                self.chain.append(scope)
                self.bind(name, "param")
                head = {"function": f"function f{name}({name} = {{}}) {{", "arrow": f"call(async ({name}) => {{", "method": f"call({{ m({name}) {{"}[kind]
                self.say(head)
                self.block(depth + 1)
                self.chain.pop()
                self.say({"function": "}", "arrow": "})", "method": "} })"}[kind])
                self.pending = [] if kind == "function" else ["call"]
            elif kind in ("block", "catch", "for", "class"):
                self.chain.append(("block", {}))
                if kind == "catch":
                    self.bind(name, "catch")
                    self.say(f"try {{ }} catch ({name}) {{")
                elif kind == "for":
                    self.bind(name, "const")
                    self.say(f"for (const {name} of []) {{")
                elif kind == "class":
                    self.chain.append(("function", {}))
                    self.bind(name, "param")
                    self.say(f"call(class {{ {r.choice('abc')} = 1; get {r.choice('abc')}() {{}} m({name}) {{")
                else:
                    self.say("{")
                if kind != "block":
                    self.chain.append(("block", {})) if kind == "for" else None
                self.block(depth + 1)
                self.chain.pop()
                if kind in ("for", "class"):
                    self.chain.pop()
                self.say("} })" if kind == "class" else "}")
                self.pending = ["call"] if kind == "class" else []
            deferred += [(n, list(self.chain)) for n in self.pending]
        self.later = getattr(self, "later", []) + deferred
        if depth == 0:
            self.settle(self.later)


def test_random_programs(spark):
    made = {str(seed): Program(seed) for seed in range(150)}
    files = spark.createDataFrame([(k, "\n".join(p.lines)) for k, p in made.items()], "file_id string, content string")
    want = sorted((k, *b[:4]) for k, p in made.items() for b in p.bindings)
    got = sorted((r.file_id, r.name, r.kind, r.line, r.references) for r in scopes.aliases(files.repartition(5)).collect())
    assert got == want and len(want) > 1000 and any(b[4] > 3 for b in want)
    free = sorted(tuple(r) for r in scopes.free_names(files).filter("name <> 'o'").collect())  # what members are read of
    assert free == sorted((k, n, c) for k, p in made.items() for n, c in p.free.items())


def test_forms_of_declarations(spark):
    code = (
        "import d, { a as b, c } from 'x'; import * as ns from \"y\";\nexport { b as z };\nconst { k: v, w = d, ...rest } = ns;\n"
        "const self = function own(n) { return own(n - 1) };\nclass K extends c { v = v; static async v() { v } }\nlabel: for (let i = 0; i < 2; i++) { break label }\nconst g = y => y + v\nlet last = g"
    )
    files = spark.createDataFrame([("1", code), ("2", None), ("3", ""), ("4", "((("), (None, "var q; q")], "file_id string, content string")
    got = {(r.file_id, r.name, r.kind, r.line): r.references for r in scopes.aliases(files).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "1"} == {
        "d": 1, "b": 1, "c": 1, "ns": 1, "v": 3, "w": 0, "rest": 0, "self": 0, "own": 1, "n": 1, "K": 0, "i": 2, "g": 1, "y": 1, "last": 0,
    }
    assert {k[0] for k in got} == {"1"} and scopes.aliases(files.filter("false")).count() == 0


def test_innermost_interval_of_a_hot_key(spark):
    r = random.Random(4)
    spans = [(k, 10 * k, 10 * k + 9) for k in range(500)] + [(500 + k, 10 * k + 2, 10 * k + 5) for k in range(0, 500, 3)] + [(2000, 0, 5000), (2001, -5, 6000)]
    places = [(k, r.randint(-10, 6010)) for k in range(2000)] + [(2000, None)]
    inner = lambda p: None if p is None else min(((e - s, i) for i, s, e in spans if s <= p < e), default=(0, None))[1]
    left = spark.createDataFrame([("k", *p) for p in places] + [(None, 1, 1)], "key string, id long, at long")
    right = spark.createDataFrame([("k", *s) for s in spans], "key string, id long, start long, stop long")
    got = {(x.key, x.id): x.id_found for x in innermost(left.repartition(7), right, ["key"], "at", "start", "stop", ["id"]).collect()}
    assert got == {("k", i): inner(p) for i, p in places} | {(None, 1): None}


def brute_splice(text, rows):
    """The text and each edit's reason, one edit after the other."""
    out, done, reasons, shift = text, -1, {}, 0
    for start, stop, name, new in sorted(rows, key=lambda e: (e[0] is not None, e[0] or 0, e[1] is not None, e[1] or 0, e[2])):
        if new is None:
            reasons[name] = "no replacement"
        elif start is None or stop is None or not 0 <= start <= stop <= len(text):
            reasons[name] = "outside"
        elif start < done:
            reasons[name] = "overlaps"
            done = max(done, stop)
        else:
            reasons[name], done = None, max(done, stop)
            out = out[: start + shift] + new + out[stop + shift :]
            shift += len(new) - (stop - start)
    return out, reasons


def test_random_edit_scripts(spark):
    r = random.Random(9)
    texts = {str(k): "".join(r.choice("aé😀 \n") for _ in range(r.randint(0, 60))) for k in range(120)} | {"none": None}
    rows = []
    for k, text in texts.items():
        for n in range(r.randint(0, 9)):
            start = r.choice([None, -1, *range(0, 70)])
            rows.append((k, f"e{n}", start, None if start is None else start + r.choice([-1, 0, 0, 1, 2, 5, 9]), r.choice([None, "", "x", "ÿ😀"])))
    rows.append(("lost", "e0", 0, 1, "x"))
    files = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "file_id string, content string, reason int")
    script = spark.createDataFrame(rows, edits.EDITS.replace("edit_id", "edit_id"))
    judged = edits.checked(script, files)
    assert judged.count() == len(rows)
    reasons = {(x.file_id, x.edit_id): x.reason for x in judged.collect()}
    new = {x.file_id: x.content for x in edits.spliced(files, judged.filter("reason is null")).collect()}
    assert reasons[("lost", "e0")] == "no file" and set(reasons.values()) == {None, "outside", "overlaps", "no replacement", "no file"}
    for k, text in texts.items():
        want, why = brute_splice(text or "", [(s, e, n, x) for f, n, s, e, x in rows if f == k])
        assert {n: reasons[(k, n)] for n in why} == why and (new[k] or "") == want
    assert edits.spliced(files, judged.filter("false")).filter("content is null").count() == 1


def test_renames_pass_strings_and_members(spark):
    code = "a.b = aa + a + 'a' + \"a\\\"a\" + `a ${a}` // a\n+ $a + a$ /* a */ + a"
    files = spark.createDataFrame([("f", code), ("g", None)], "file_id string, content string")
    renames = [("f", "r1", "a", "first", 0.9, "low", None, None), ("f", "r2", "b", "second", 0.9, "low", 0, 3), ("f", "r3", "b", "third", 0.9, "low", 3, 90), ("g", "r4", "a", "x", 1.0, "low", None, None), ("f", "r5", "aa", "y", 0.5, "low", None, None)]
    candidates = spark.createDataFrame(renames, "file_id string, rename_id string, symbol string, new_name string, confidence double, risk string, `from` long, upto long")
    changed, report = edits.applied_renames(files, candidates)
    texts = {r.file_id: r.content for r in changed.collect()}
    assert texts == {"f": re.sub(r"^a\.b", "first.second", code).replace("+ a +", "+ first +", 1)[:-1] + "first", "g": None}
    assert {tuple(r) for r in report.collect()} == {("f", "r1", 3, 0), ("f", "r2", 1, 0), ("f", "r3", 0, 0), ("g", "r4", 0, 0)}
    assert len(edits.selected_renames(candidates, 0.0, 2).collect()) == 2


@pytest.mark.parametrize("where", ["files", "edits"])
def test_empty_tables(spark, where):
    files = spark.createDataFrame([("f", "a")] if where == "edits" else [], "file_id string, content string")
    script = spark.createDataFrame([] if where == "edits" else [("f", "e", 0, 1, "b")], edits.EDITS)
    judged = edits.checked(script, files)
    assert edits.spliced(files, judged.filter("reason is null")).count() == files.count()
