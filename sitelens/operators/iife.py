"""Sections of a script that is one big function call: statements by kind, grouped as they follow each other.

Cutting one file's text into statements is Python; grouping is a fold per file, and what
follows from the groups are windows and aggregations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.modules import BATCH_ROWS, blanked
from sitelens.operators.ranges import Step, fold_groups

ITEMS = "file_id string, at long, type string, name string, lines long"
#: The fewest statements of a body, the share of them that makes an inner body the real one,
#: lines below which a group joins the one before it, and lines from which a function is a unit of its own.
LEAST_STATEMENTS, INNER_SHARE, TINY_LINES, UNIT_LINES = 6, 0.5, 10, 51
#: Categories of statement types, and the lines below which a category takes in another's statement.
CATEGORIES = {"class": "class", "alias": "class", "component": "component", "enum": "enum", "function": "function", "var": "var", "return": "bootstrap", "iife": "bootstrap"}
ABSORBS = {("class", "var"): 5, ("component", "var"): 10, ("component", "function"): 30}
_NUMBER = {c: k for k, c in enumerate(("class", "component", "enum", "function", "var", "bootstrap", "other"))}

_CALLED = re.compile(r"\s*[!(]?\s*\(?\s*(?:async\s+)?(?:function\b[^(]*\([^()]*\)|\([^()]*\)\s*=>|[A-Za-z_$][\w$]*\s*=>)\s*\{")
_UNIT = re.compile(r"\s*(?:async\s+)?(?:function\b|class\b)")
_BRACKETS = re.compile(r"[{}()\[\];\n]")
_VARIABLE = re.compile(r"\s*(?:var|let|const)\s+([A-Za-z_$][\w$]*)\s*(?:=\s*(class\b|[A-Za-z_$][\w$]*\s*(?=[;,\s]*\Z))?)?")


def _closing(plain: str) -> dict[int, int]:
    """Where each opening bracket of blanked code is closed."""
    open_, found = [], {}
    for m in _BRACKETS.finditer(plain):
        if m[0] in "{([":
            open_.append(m.start())
        elif m[0] in "})]" and open_:
            found[open_.pop()] = m.start()
    return found


def spans(plain: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Statements between two places of blanked code: cut at ``;``, after function and class bodies, and after a block that ends a line."""
    out, depth, start = [], 0, begin
    shut = None  # how far all is blank after a closing brace
    for m in _BRACKETS.finditer(plain, begin, end):
        c = m[0]
        depth += (c in "{([") - (c in "})]")
        if shut is not None and plain[shut : m.start()].strip():
            shut = None
        shut = m.end() if c == "}" or c == "\n" and shut is not None else None
        if depth == 0 and (c == ";" or c == "}" and _UNIT.match(plain, start) or c == "\n" and shut is not None):
            if plain[start : m.end()].strip(" \n\t\r;"):
                out.append((start, m.end()))
            start, shut = m.end(), None
    if plain[start:end].strip(" \n\t\r;"):
        out.append((start, end))
    return out


def _called_body(plain: str, a: int, b: int, closing: dict[int, int]) -> tuple[int, int] | None:
    """The body of a statement that calls a function where it is written."""
    m = _CALLED.match(plain, a, b)
    if not m or plain[a:b].lstrip()[:1] not in ("!", "(", "+", "-", "~"):
        return None
    shut = closing.get(m.end() - 1)
    return (m.end(), shut) if shut is not None and re.match(r"\s*\)?\s*(?:\.call\s*)?\(", plain[shut + 1 : b]) else None


def body_spans(plain: str) -> list[tuple[int, int]]:
    """The statements of the body that holds the bulk of a script; those of the script itself if it calls none."""
    closing = _closing(plain)
    top = spans(plain, 0, len(plain))
    for a, b in top:
        if (body := _called_body(plain, a, b, closing)) and len(found := spans(plain, *body)) >= LEAST_STATEMENTS:
            for c, d in found:
                if (inner := _called_body(plain, c, d, closing)) and len(deeper := spans(plain, *inner)) > INNER_SHARE * len(found):
                    return deeper
            return found
    return top


def statement_type(code: str, plain: str) -> tuple[str, str | None]:
    """(type, name) of a statement; plain is its code with strings and comments blanked."""
    if m := re.match(r"\s*class\s+([A-Za-z_$][\w$]*)?", plain):
        return "class", m[1]
    if m := _VARIABLE.match(plain):
        if m[2] == "class":
            return "class", m[1]
        if "Object.freeze" in code and "(" in plain and re.search(r"\w+:\s*\d+", code):
            return "enum", m[1]
        return ("alias" if m[2] and m[2][:1].isupper() else "var"), m[1]
    if m := re.match(r"\s*(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)?", plain):
        shown = m[1] and m[1][:1].isupper() or any(w in code for w in ("useState", "useEffect", "useContext", "jsx", "createElement"))
        return ("component" if shown else "function"), m[1]
    if re.match(r"\s*return\b", plain):
        return "return", None
    if re.match(r"\s*(?:if|for|while|switch|try|do|throw|import|export)\b", plain):
        return "other", None
    if "Object.freeze" in code:
        return "enum", None
    return ("iife" if _called_body(plain, 0, len(plain), _closing(plain)) else "expression"), None


def items(files: DataFrame) -> DataFrame:
    """(file_id, at, type, name, lines) of the statements of each script's main body; null and empty files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        held: list[tuple] = []
        for rows in batches:
            for key, code in zip(rows["file_id"], rows["content"]):
                plain = blanked(code or "")
                for at, (a, b) in enumerate(body_spans(plain)):
                    a += len(plain[a:b]) - len(plain[a:b].lstrip())
                    held.append((key, at, *statement_type(code[a:b], plain[a:b]), code[a:b].rstrip().count("\n") + 1))
                if len(held) >= BATCH_ROWS:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        yield pd.DataFrame(held, columns=names)

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInPandas(run, ITEMS)


def grouping() -> Step:
    """The fold over lines * 8 + category: a group takes in its own category, and small statements of some others."""
    absorbs = {(_NUMBER[a], _NUMBER[b]): most for (a, b), most in ABSORBS.items()}

    def step(state: tuple | None, value: int) -> tuple[tuple, int]:
        lines, category = divmod(value, 8)
        if state is None:
            return (0, category), 0
        group, kind = state
        joins = kind == category or lines < absorbs.get((kind, category), 0)
        return (state, group) if joins else ((group + 1, category), group + 1)

    return step


def splitting(target: int) -> Step:
    """The fold over lines * 2 + unit: a started part ends before a unit that would take it over the target."""

    def step(state: tuple | None, value: int) -> tuple[tuple, int]:
        lines, unit = divmod(value, 2)
        part, held = state or (0, 0)
        if unit and held and held + lines > target:
            part, held = part + 1, 0
        return (part, held + lines), part

    return step


def sections(files: DataFrame, target: int = 5000) -> DataFrame:
    """(file_id, section, category, first, statements, lines, names): groups in order, tiny ones joined to the one before, large ones split."""
    rows = items(files)
    category = F.lit("other")
    for kind, name in CATEGORIES.items():
        category = F.when(F.col("type") == kind, name).otherwise(category)
    number = F.lit(_NUMBER["other"])
    for name, k in _NUMBER.items():
        number = F.when(category == name, k).otherwise(number)
    rows = rows.withColumn("category", category).withColumn("value", F.col("lines") * 8 + number)
    held = ["type", "name", "lines"]
    rows = fold_groups(rows.filter("file_id is not null"), ["file_id"], ["at"], "value", grouping(), "group", [*held, "category"])
    # A tiny group joins the last one before it that isn't, leading ones stay together; the first statement names what they make up.
    size = F.sum("lines").over(Window.partitionBy("file_id", "group"))
    before = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.max(F.when(F.col("size") >= TINY_LINES, F.col("group"))).over(before)
    rows = rows.withColumn("size", size).withColumn("into", F.coalesce(anchor, F.lit(-1)))
    unit = F.col("type").isin("class", "component") | ((F.col("type") == "function") & (F.col("lines") >= UNIT_LINES))
    rows = rows.withColumn("value", F.col("lines") * 2 + unit.cast("int"))
    rows = rows.withColumn("category", F.first("category").over(Window.partitionBy("file_id", "into").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    parts = fold_groups(rows, ["file_id", "into"], ["at"], "value", splitting(target), "part", ["name", "lines", "category"])
    out = parts.groupBy("file_id", "into", "part").agg(
        F.min("category").alias("category"), F.min("at").alias("first"), F.count("*").alias("statements"), F.sum("lines").alias("lines"), F.array_sort(F.collect_set("name")).alias("names")
    )
    section = F.row_number().over(Window.partitionBy("file_id").orderBy("first")) - 1
    return out.select("file_id", section.alias("section"), "category", "first", "statements", "lines", "names")
