"""Scoped names of scripts: which declaration every occurrence of a name belongs to.

One pass over the files, each of which lies whole in its row: its tokens give the stretches that
are scopes and the places of names, and these are settled there and then, so that only bindings
and their counts leave the task. A declaration binds in the innermost scope around it (a ``var``
or function in the innermost function or program), a scope binds a name once, and an occurrence
belongs to the innermost scope around it that binds its name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.tokens import RESERVED, Token, ends_operand, tokens

#: A row is what a scope [start, stop) binds, first declared at a line and column, or a name that no scope binds (all but name and places null).
SETTLED = "file_id string, name string, kind string, start long, stop long, line long, column long, places long"
HOISTED = ("var", "function")
_LINE_END = re.compile("\n")
#: Rows of a batch that a pass over files gives, about.
BATCH_ROWS = 20_000
_OPEN = {"(": ")", "[": "]", "{": "}", "${": "}"}
_CLOSE = frozenset(_OPEN.values())
_CONTROL = frozenset("if for while switch with catch".split())
_PREFIX = frozenset("static get set async".split())
#: Words and marks that declare something or begin a scope.
_TELLING = frozenset("function class var let const import export catch for ( => {".split())


class _Parse:
    """Scopes and names of one file; see _parse."""

    def __init__(self, code: str, lines: list[int]):
        self.t: list[Token] = list(tokens(code))
        self.texts = [text if kind in ("name", "mark") else "" for kind, text, _ in self.t]
        self.end, self.lines = len(code), lines
        self.close = self._pairs()
        self.scopes: list[tuple[str, int, int]] = [("program", -1, len(code) + 1)]  # around all others, which may span the whole text
        self.declared: dict[int, tuple[str, int]] = {}
        self.skipped: set[int] = set()
        self.bodies: set[int] = set()
        self.classes: set[int] = set()
        self.parameters: set[int] = set()
        for k, text in enumerate(self.texts):
            if text in _TELLING:
                self._word(k, text) if self.t[k][0] == "name" else self._mark(k, text)

    def _pairs(self) -> dict[int, int]:
        """For each opening mark the place of its partner; what stays open ends with the text."""
        found, stack = {}, []
        for k, text in enumerate(self.texts):
            if text in _OPEN:
                stack.append(k)
            elif text in _CLOSE and stack and _OPEN[self.texts[stack[-1]]] == text:
                found[stack.pop()] = k
        return found | {k: len(self.t) for k in stack}

    def text(self, k: int) -> str:
        return self.texts[k] if 0 <= k < len(self.texts) else ""

    def is_name(self, k: int) -> bool:
        return 0 <= k < len(self.t) and self.t[k][0] == "name"

    def place(self, k: int) -> int:
        return self.t[k][2] if k < len(self.t) else self.end

    def after(self, k: int) -> int:
        """Where the partner of an opening mark ends."""
        return min(self.end, self.place(self.close[k]) + 1)

    def scope(self, kind: str, start: int, stop: int) -> None:
        if stop > start:
            self.scopes.append((kind, start, stop))

    def expression_end(self, k: int) -> int:
        """The token after an expression that begins at k: an outer mark, or what a line begins with after an operand."""
        asked, first = 0, k
        while k < len(self.t):
            kind, text, start = self.t[k]
            if kind == "mark" and text in _OPEN:
                k = self.close[k] + 1
                continue
            if kind == "mark" and (text in ",;)]}" or text == ":" and not asked):
                return k
            asked += (text == "?") - (text == ":") if kind == "mark" else 0
            before = self.t[k - 1]
            begins = kind in ("name", "number", "string") and text not in ("in", "of", "instanceof")
            if k > first and begins and (ends_operand(before) or before[1] == "}") and self.breaks(k):
                return k
            k += 1
        return k

    def breaks(self, k: int) -> bool:
        """Whether a line ends between a token and the one before it."""
        return bisect_right(self.lines, self.place(k)) > bisect_right(self.lines, self.place(k - 1))

    def body(self, k: int) -> int:
        """Where a function's body that begins at token k ends."""
        if self.text(k) == "{":
            self.bodies.add(k)
            return self.after(k)
        return self.place(self.expression_end(k))

    def pattern(self, k: int, end: int, kind: str) -> None:
        """Declare the names of a binding pattern."""
        while k < end:
            text = self.text(k)
            if text == "=":
                k += 1
                while k < end and self.text(k) != ",":
                    k = self.close[k] + 1 if self.t[k][0] == "mark" and self.text(k) in _OPEN else k + 1
                continue
            if text in ("[", "{"):
                if text == "{" or self.text(self.close[k] + 1) != ":":
                    self.pattern(k + 1, self.close[k], kind)
                self.bodies.add(k)
                k = self.close[k]
            elif self.is_name(k) and self.text(k + 1) == ":":
                self.skipped.add(k)
            elif self.is_name(k) and text not in RESERVED:
                self.declared[k] = (kind, self.place(k))
            k += 1

    def function(self, k: int, kind: str = "function") -> int:
        """A scope from the parameters at k to the end of the body; returns its start."""
        self.parameters.add(k)
        self.pattern(k + 1, self.close[k], "catch" if kind == "catch" else "param")
        self.scope(kind, self.place(k), self.body(self.close[k] + 1))
        return self.place(k)

    def begins_statement(self, k: int) -> bool:
        before = self.text(k - 1)
        if before == "async":
            return self.begins_statement(k - 1)
        return k == 0 or before in (";", "{", "}", ")", "export", "default", "else", "") and self.t[k - 1][0] != "number" or self.breaks(k) and ends_operand(self.t[k - 1])

    def _word(self, k: int, text: str) -> None:
        before, after = self.text(k - 1), self.text(k + 1)
        if before in (".", "?."):
            return
        if text == "function":
            at = k + 2 if after == "*" else k + 1
            name = at if self.is_name(at) else None
            at += name is not None
            if self.text(at) == "(":
                start = self.function(at)
                if name is not None:
                    self.declared[name] = ("function", self.place(name) if self.begins_statement(k) else start)
        elif text == "class":
            name = k + 1 if self.is_name(k + 1) and after != "extends" else None
            at = k + 1
            while at < len(self.t) and self.text(at) != "{":
                at = self.close[at] + 1 if self.t[at][0] == "mark" and self.text(at) in _OPEN else at + 1
            if at < len(self.t):
                self.classes.add(at)
                self.scope("class", self.place(at), self.after(at))
                if name is not None:
                    self.declared[name] = ("class", self.place(name) if self.begins_statement(k) else self.place(at))
        elif text in ("var", "let", "const") and (self.is_name(k + 1) or after in ("[", "{")):
            self.declarators(k + 1, text)
        elif text == "import" and after not in ("(", "."):
            self.imports(k + 1)
        elif text == "export" and after == "{":
            self.exports(k + 1)
        elif text == "catch" and after == "(":
            self.function(k + 1, "catch")
        elif text == "for":
            at = k + 2 if after == "await" else k + 1
            if self.text(at) == "(":
                body = self.close[at] + 1
                self.parameters.add(at)
                self.skipped |= {j for j in range(at + 2, body - 1) if self.text(j) == "of" and (self.is_name(j - 1) or self.text(j - 1) in ("]", "}"))}
                self.scope("block", self.place(at), self.after(body) if self.text(body) == "{" else self.place(self.expression_end(body)))

    def declarators(self, k: int, kind: str) -> None:
        while k < len(self.t):
            if self.text(k) in ("[", "{"):
                self.pattern(k, self.close[k] + 1, kind)
                k = self.close[k] + 1
            elif self.is_name(k) and self.text(k) not in RESERVED:
                self.declared[k] = (kind, self.place(k))
                k += 1
            if self.text(k) == "=":
                k = self.expression_end(k + 1)
            if self.text(k) != ",":
                return
            k += 1

    def imports(self, k: int) -> None:
        while k < len(self.t) and self.t[k][0] != "string" and self.text(k) != ";":
            if self.is_name(k):
                renamed = self.text(k + 1) == "as"
                word = self.text(k) in ("as", "from") and (self.is_name(k - 1) or self.text(k - 1) in ("*", "}"))
                if renamed or word or self.text(k) in RESERVED:
                    self.skipped.add(k)
                else:
                    self.declared[k] = ("import", self.place(k))
            elif self.text(k) == "{":
                self.bodies.add(k)
            k += 1

    def exports(self, k: int) -> None:
        self.bodies.add(k)
        end, whole = self.close[k], self.text(self.close[k] + 1) == "from"
        for at in range(k + 1, end):
            if self.is_name(at) and (whole or self.text(at) == "as" and self.is_name(at - 1) or self.text(at - 1) == "as"):
                self.skipped.add(at)
        if whole:
            self.skipped.add(end + 1)

    def _mark(self, k: int, text: str) -> None:
        before = self.t[k - 1] if k else None
        if text == "(" and k not in self.parameters:
            after = self.close[k] + 1
            if self.text(after) == "=>":
                if before == ("name", "async", before and before[2]):
                    self.skipped.add(k - 1)
                self.parameters.add(k)
                self.pattern(k + 1, self.close[k], "param")
                self.scope("function", self.place(k), self.body(after + 1))
            elif self.text(after) == "{" and before and (before[0] in ("name", "string", "number") and before[1] not in _CONTROL or before[1] == "]") and not self.breaks(after):
                self.skipped.add(k - 1)
                self.function(k)
        elif text == "=>" and before and before[0] == "name":
            self.declared[k - 1] = ("param", before[2])
            self.scope("function", before[2], self.body(k + 1))
        elif text == "{" and k not in self.bodies and k not in self.classes:
            self.scope("block", self.place(k), self.after(k))

    def names(self) -> Iterator[tuple[int, str, str | None, int | None]]:
        """(place, name, declared, binds_at) of all names that are no keys, members or labels."""
        inside: list[int] = []
        texts = [*self.texts, "", ""]  # so that there is one after the last and, at -1, before the first
        for k, (kind, text, start) in enumerate(self.t):
            if kind == "mark":
                if text in _OPEN:
                    inside.append(k)
                elif text in _CLOSE and inside:
                    inside.pop()
            elif kind == "name":
                if k in self.declared:
                    yield (start, text, *self.declared[k])
                    continue
                before, after = texts[k - 1], texts[k + 1]
                if text in RESERVED or before in (".", "?.", "#") or k in self.skipped:
                    continue
                label = before in ("break", "continue") and not self.breaks(k)
                key = after == ":" and before in ("{", ",", ";", "}", "")
                field = bool(inside) and inside[-1] in self.classes and before in ("{", ";", "}", "#", *_PREFIX) and after in ("=", ";", "}")
                prefix = text in _PREFIX and (self.is_name(k + 1) or after in ("[", "*", "#"))
                if not (label or key or field or prefix):
                    yield (start, text, None, None)


def _around(points: Iterable[int], intervals: Iterable[tuple[int, int]]) -> list[tuple[int, int] | None]:
    """The innermost interval [start, stop) that holds each of ascending points; intervals nest or are apart."""
    ordered, at, open_, out = sorted(intervals, key=lambda x: (x[0], -x[1])), 0, [], []
    for point in points:
        while at < len(ordered) and ordered[at][0] <= point:
            while open_ and open_[-1][1] <= ordered[at][0]:
                open_.pop()
            open_.append(ordered[at])
            at += 1
        while open_ and open_[-1][1] <= point:
            open_.pop()
        out.append(open_[-1] if open_ else None)
    return out


def _parse(code: str) -> tuple[list[tuple], list[tuple]]:
    """(name, kind, start, stop, line, column, places) of what the scopes of a text bind, and (name, places) of its free names."""
    lines = [m.start() for m in _LINE_END.finditer(code)]
    found = _Parse(code, lines)
    declared, uses = [], {}
    for at, name, kind, binds in found.names():
        if kind is None:
            uses.setdefault(name, []).append(at)
        else:
            declared.append((at, name, kind, binds))
    every = {(start, stop) for _, start, stop in found.scopes}
    outer = {(start, stop) for kind, start, stop in found.scopes if kind in ("program", "function")}
    own: dict[int, tuple[int, int] | None] = {}  # of each declaration's place
    for hoisted, within in ((True, outer), (False, every)):
        chosen = sorted((binds, at) for at, _, kind, binds in declared if (kind in HOISTED) == hoisted)
        own |= zip((at for _, at in chosen), _around((binds for binds, _ in chosen), within))
    bound: dict[str, dict[tuple[int, int], list]] = {}
    for at, name, kind, _ in declared:  # in the order of their places, so the first one names the binding
        bound.setdefault(name, {}).setdefault(own[at], [kind, at, 0])[2] += 1
    free = []
    for name, places in uses.items():
        scopes, unbound = bound.get(name), len(places)
        if scopes:
            unbound = 0
            for scope in _around(places, scopes):
                if scope is None:
                    unbound += 1
                else:
                    scopes[scope][2] += 1
        if unbound:
            free.append((name, unbound))
    rows = []
    for name, scopes in bound.items():
        for (start, stop), (kind, at, places) in scopes.items():
            line = bisect_right(lines, at)
            rows.append((name, kind, start, stop, line + 1, at - (lines[line - 1] if line else -1), places))
    return rows, free


def settled(files: DataFrame, free: bool) -> DataFrame:
    """Rows of SETTLED for a table with file_id and content: free names, or else bindings.

    Places are the occurrences of a binding, its declarations included, or of a free name.
    Null contents are empty, and have no rows; files without an id are left out. Each row of the
    table is a file of its own, also where ids are repeated. The text is cut by tokens, not by a
    full grammar: a stretch in braces is a scope even where it is an object, which binds nothing.
    """
    kinds = {n: pa.string() if t == "string" else pa.int64() for n, t in (c.split() for c in SETTLED.split(", "))}

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bound, unbound = _parse(code or "")
                held += [(key, name, None, None, None, None, None, places) for name, places in unbound] if free else [(key, *row) for row in bound]
                if len(held) > BATCH_ROWS:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    named = files.filter("file_id is not null")
    return named.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(run, SETTLED)


def aliases(files: DataFrame) -> DataFrame:
    """(file_id, name, kind, line, column, scope_start, scope_stop, references) of every binding.

    References are its occurrences but for one, the declaration. Files without declarations
    have no rows, and an empty table gives an empty one.
    """
    scope = F.greatest("start", F.lit(0)).alias("scope_start"), F.col("stop").alias("scope_stop")
    return settled(files, free=False).select("file_id", "name", "kind", "line", "column", *scope, (F.col("places") - 1).alias("references"))


def free_names(files: DataFrame) -> DataFrame:
    """(file_id, name, occurrences) of the names that no scope of their file binds."""
    return settled(files, free=True).select("file_id", "name", F.col("places").alias("occurrences"))
