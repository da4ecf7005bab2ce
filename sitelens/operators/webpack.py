"""Module tables of bundlers: factories by number, what they require, edges between them.

Only finding the tables in one file's text is Python, in time linear in the text; edges are
a join on the module's number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.modules import BATCH_ROWS, blanked

MODULES = "file_id string, at long, module string, start long, size long, requires array<string>, exports array<string>, stop long"
#: An object with at least so many numbered factories is a table; of an array, at least this share are functions.
LEAST_FACTORIES, LEAST_SHARE = 2, 0.4
#: Confidence of a factory, what a require and a long body add, and the bytes that make a body long.
BASE_SCORE, REQUIRE_BONUS, LONG_BONUS, LONG_BYTES, MOST_SCORE = 0.76, 0.04, 0.04, 500, 0.95

_FACTORY = re.compile(r"\s*(?:function\b[^(]*\(([^()]*)\)\s*\{|\(([^()]*)\)\s*=>|([A-Za-z_$][\w$]*)\s*=>)")
_METHOD = re.compile(r"\s*\(([^()]*)\)\s*\{")
_KEY = re.compile(r"""\s*(?:(\d+)|["']([^"'\n]*)["']|([A-Za-z_$][\w$]*))\s*(:|(?=\())""")
_GETTER = re.compile(r"([A-Za-z_$][\w$]*)\s*:\s*(?:\(\s*\)\s*=>|function\s*\()")


def _containers(plain: str) -> Iterator[tuple[str, int, int, list[int]]]:
    """(bracket, begin, end, top-level commas) of every bracket pair of blanked code, by begin."""
    open_, found = [], []
    for m in re.finditer(r"[\[\](){},]", plain):
        c, at = m[0], m.start()
        if c in "[({":
            open_.append((c, at, []))
        elif c == ",":
            if open_:
                open_[-1][2].append(at)
        elif open_:
            kind, begin, commas = open_.pop()
            found.append((kind, begin, at, commas))
    return iter(sorted(found, key=lambda x: x[1]))


def _elements(begin: int, end: int, commas: list[int]) -> list[tuple[int, int]]:
    edges = [begin, *commas, end]
    return [(a + 1, b) for a, b in zip(edges, edges[1:])]


def _table(code: str, plain: str, kind: str, elements: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
    """(module, start, end, parameters) of the factories of a container; empty if it is no table."""
    out, numbered = [], 0
    for k, (a, b) in enumerate(elements):
        if kind == "[":
            if m := _FACTORY.match(plain, a, b):
                out.append((str(k), a + len(m[0]) - len(m[0].lstrip()), b, next(p for p in m.groups() if p is not None)))
        elif key := _KEY.match(code, a, b):
            m = _FACTORY.match(plain, key.end(), b) if key[4] else _METHOD.match(plain, key.end(), b)
            if m:
                name = key[1] or key[2] or key[3] or ""
                numbered += name.isdigit()
                out.append((name, m.start() + len(m[0]) - len(m[0].lstrip()), b, next(p for p in m.groups() if p is not None)))
    if kind == "[":
        return out if len(out) >= LEAST_FACTORIES and len(out) >= LEAST_SHARE * len(elements) else []
    return out if numbered >= LEAST_FACTORIES else []


def factories(code: str) -> list[tuple[str, int, int, str]]:
    """Factories of the outermost tables of a script, in order."""
    plain = blanked(code)
    out, covered = [], -1
    for kind, begin, end, commas in _containers(plain):
        if kind == "(" or begin < covered or not commas and kind == "{":
            continue
        if found := _table(code, plain, kind, _elements(begin, end, commas)):
            out += found
            covered = end
    return out


def _read(key: str, code: str) -> list[tuple]:
    plain = blanked(code)
    out = []
    for at, (module, start, end, parameters) in enumerate(factories(code)):
        names = [p.strip() for p in parameters.split(",")]
        body, clean = code[start:end], plain[start:end]
        requires: list[str] = []
        if len(names) > 2 and names[2]:
            # Shorter numbers are too often something else.
            requires = re.findall(rf"(?<![\w$.]){re.escape(names[2])}\((\d{{3,}})\)", clean)
        exports = []
        if len(names) > 2 and names[2]:
            for m in re.finditer(rf"(?<![\w$.]){re.escape(names[2])}\.d\([^,()]*,\s*\{{", clean):
                shut = clean.find("})", m.end())
                exports += _GETTER.findall(clean[m.end() : shut if shut >= 0 else len(clean)])
        size = len(body.encode("utf-8", "surrogatepass"))
        out.append((key, at, module, start, size, list(dict.fromkeys(requires)), sorted(set(exports)), end))
    return out


def modules(files: DataFrame) -> DataFrame:
    """(file_id, at, module, start, size, requires, exports, stop, score) of every factory of a table of scripts.

    start and stop count code points, size is of bytes.
    Null and empty files, and files without a module table, have none. Comments and strings
    don't count. A number that repeats in a file keeps its rows; edges go to the last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in MODULES.split(", ")]
        held: list[tuple] = []
        for rows in batches:
            for key, code in zip(rows["file_id"], rows["content"]):
                held += _read(key, code or "")
                if len(held) >= BATCH_ROWS:
                    yield pd.DataFrame(held, columns=names)
                    held = []
        yield pd.DataFrame(held, columns=names)

    found = files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInPandas(run, MODULES)
    score = F.lit(BASE_SCORE) + F.when(F.size("requires") > 0, REQUIRE_BONUS).otherwise(0.0) + F.when(F.col("size") >= LONG_BYTES, LONG_BONUS).otherwise(0.0)
    return found.withColumn("score", F.round(F.least(F.lit(MOST_SCORE), score), 6))


def edges(found: DataFrame) -> DataFrame:
    """(file_id, source, target): requires of modules that the file defines; the last definition of a number counts, a module itself doesn't."""
    # A module's own number and those it requires are rows of one pass, which meet by number: what defines it, and what asks for it.
    own = F.array(F.struct(F.col("module").alias("target"), F.lit(True).alias("defines")))
    asked = F.transform("requires", lambda r: F.struct(r.alias("target"), F.lit(False).alias("defines")))
    named = found.filter("file_id is not null").select("file_id", "at", F.col("module").alias("source"), F.explode(F.concat(own, asked)).alias("n")).select("file_id", "at", "source", "n.*")
    met = named.withColumn("to", F.max(F.when(F.col("defines"), F.col("at"))).over(Window.partitionBy("file_id", "target")))
    return met.filter(~F.col("defines") & (F.col("at") != F.col("to"))).select("file_id", "source", "target").distinct()


def importers(found: DataFrame) -> DataFrame:
    """(file_id, module, importers): how many modules require each one that is required."""
    return edges(found).groupBy("file_id", F.col("target").alias("module")).agg(F.count("*").alias("importers"))


def remainder(files: DataFrame, found: DataFrame) -> DataFrame:
    """(file_id, start, end): what lies between and around the factories of each file that has some."""
    sized = files.select(F.col("file_id").cast("string").alias("file_id"), F.length("content").cast("long").alias("length"))
    spans = found.select("file_id", "start", F.col("stop").alias("end"))
    marks = spans.unionByName(sized.join(spans.select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.col("length").alias("start"), F.col("length").alias("end")))
    order = Window.partitionBy("file_id").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marks.select("file_id", before.alias("start"), F.col("start").alias("end")).filter(F.col("start") < F.col("end"))
