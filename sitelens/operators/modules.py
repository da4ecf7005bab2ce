"""Module graph of script bundles: statements, clusters, edges, scores.

Only the cut of one file's text into top-level statements is Python; clusters are an
ordered fold per file, and symbols, edges and scores are joins and aggregations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators import scoring
from sitelens.operators.ranges import Step, fold
from sitelens.registry import spread

STATEMENTS = "file_id string, stmt long, start long, size long, kind string, declares array<string>, exports array<string>, imports array<string>, dynamic_imports array<string>, uses array<string>, module long"
TINY, LARGEST = 120, 4000
#: Statements of a batch, about.
BATCH_ROWS = 10_000
ENTRY_SCORE, BASE_SCORE = 0.18, 0.3

#: Where something to blank may begin; comments, strings and templates as a whole; and regular expressions, which stand where an operand is expected.
_BEGINS = re.compile(r"""["'`/]""")
_SKIP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_MARKS = re.compile(r"[{}()\[\];\n]")
_BEFORE_OPERAND = frozenset("=(,:;!&|?{}[+-*%~^<>\n")
_OPERAND_WORDS = ("return", "typeof", "case")
_KIND = re.compile(r"(?:import|export|function|class|const|let|var)\b")
_DECLARED = re.compile(r"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([A-Za-z_$][\w$]*)")
_MORE = re.compile(r",\s*([A-Za-z_$][\w$]*)\s*=")
_NAME = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*")
_EXPORTED = re.compile(r"([A-Za-z_$][\w$]*)(?:\s+as\s+([A-Za-z_$][\w$]*))?")
#: Words to look for stand first, so that what isn't one is passed over quickly; what stands before them is looked at after.
_FROM = re.compile(r"""from(?<!\wfrom)\s*["']([^"']+)["']""")
_IMPORTED = re.compile(r"""\s*import\s*["']([^"']+)["']""")
_DYNAMIC = re.compile(r"""import(?<!\wimport)\s*\(\s*["']([^"']+)["']""")


def _operand_place(code: str, at: int) -> int | None:
    """Where the blanks before a slash begin, if what stands before them makes it the start of a regular expression."""
    while at and code[at - 1] in " \t":
        at -= 1
    if at == 0 or code[at - 1] in _BEFORE_OPERAND:
        return at
    for word in _OPERAND_WORDS:
        if code.endswith(word, 0, at):
            before = code[at - len(word) - 1 : at - len(word)]
            return None if before.isalnum() or before == "_" else at
    return None


def blanked(code: str) -> str:
    """The code with comments and string contents replaced by spaces, place for place."""
    out, done, m = [], 0, _BEGINS.search(code)
    while m:
        at = m.start()
        found, first = _SKIP.match(code, at), at
        if not found and m[0] == "/" and (first := _operand_place(code, at)) is not None:
            found = _PATTERN.match(code, at)
        if found:
            at, text = first, code[first : found.end()]
            out += [code[done:at], re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)]
            done = found.end()
        m = _BEGINS.search(code, found.end() if found else at + 1)
    return "".join([*out, code[done:]])


def statement_spans(plain: str) -> Iterator[tuple[int, int]]:
    """Top-level statements of blanked code: cut at ``;``, and after a block that ends a line."""
    depth = start = 0
    shut = None  # how far all is blank after a closing brace
    for m in _MARKS.finditer(plain):
        c = m[0]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth = max(0, depth - 1)
        if shut is not None and plain[shut : m.start()].strip():
            shut = None
        shut = m.end() if c == "}" or c == "\n" and shut is not None else None
        if depth == 0 and (c == ";" or c == "\n" and shut is not None):
            if plain[start : m.end()].strip(" \n\t\r;"):
                yield start, m.end()
            start, shut = m.end(), None
    if plain[start:].strip(" \n\t\r;"):
        yield start, len(plain)


def _sources(code: str) -> list[str]:
    """What an import or export statement takes from: a bare import's file, and what follows ``from``."""
    bare = _IMPORTED.match(code)
    return [*([bare[1]] if bare else []), *[m[1] for m in _FROM.finditer(code, bare.end() if bare else 0)]]


def _uses(flat: str, declared: list[str]) -> list[str]:
    return sorted(set(_NAME.findall(flat)) - set(declared))


def _statement(code: str, plain: str) -> tuple:
    flat = " ".join(plain.split())  # as many blanks as there are don't tell names apart
    kind = m[0] if (m := _KIND.match(flat)) else "expression"
    declared = [m[1]] if (m := _DECLARED.match(flat)) else []
    if declared and kind in ("const", "let", "var"):
        declared += _MORE.findall(flat)
    exported = list(declared) if kind == "export" else []
    if kind == "export" and (block := re.search(r"\{([^}]*)\}", flat)) and not declared:
        exported = [b or a for a, b in _EXPORTED.findall(block[1])]
    return flat, kind, declared, exported


def statements(files: DataFrame, wanted: Sequence[str] = ()) -> DataFrame:
    """Top-level statements of a table with file_id and content, and the module each belongs to; null and empty files have none.

    ``wanted`` are the columns to make, all if empty: what isn't asked for isn't sought.
    """
    types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    shapes = {n: k for n, k in (c.split() for c in STATEMENTS.split(", "))}
    shapes = {n: shapes[n] for n in wanted or shapes}
    told, clustered = shapes.keys() & {"kind", "declares", "exports", "imports", "uses"}, "module" in shapes

    def columns(key: str, code: str) -> dict[str, list]:
        plain = blanked(code)
        spans = list(statement_spans(plain))
        sizes, codes = [b - a for a, b in spans], [code[a:b] for a, b in spans]
        out = {"file_id": [key] * len(spans), "stmt": range(len(spans)), "start": [a for a, _ in spans], "size": sizes}
        if told:
            flats, out["kind"], out["declares"], out["exports"] = zip(*[_statement(c, plain[a:b]) for c, (a, b) in zip(codes, spans)]) if spans else [()] * 4
            out["imports"] = [_sources(c) if kind in ("import", "export") else [] for c, kind in zip(codes, out["kind"])]
            if "uses" in told:
                out["uses"] = map(_uses, flats, out["declares"])
        if "dynamic_imports" in shapes:
            out["dynamic_imports"] = [_DYNAMIC.findall(c) if "import" in c else [] for c in codes]
        if clustered:
            out["module"] = fold(clusters(), sizes)
        return out

    def pack(held: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_array(held[n], types[k]) for n, k in shapes.items()], names=list(shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in shapes}
        rows = next(iter(held.values()))
        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if code:
                    found = columns(key, code)
                    for n, values in held.items():
                        values += found[n]
                if len(rows) >= BATCH_ROWS:
                    yield pack(held)
                    for values in held.values():
                        values.clear()
        if rows:
            yield pack(held)

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(run, ", ".join(f"{n} {k}" for n, k in shapes.items()))


def _array(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.append(0, np.cumsum(np.fromiter(map(len, values), np.int64, len(values))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(chain.from_iterable(values)), pa.string()))


def clusters() -> Step:
    """The fold: what follows joins while it, or the cluster, is tiny and the whole isn't too large."""

    def step(state: tuple | None, size: int) -> tuple[tuple, int]:
        if state is None:
            return (0, size), 0
        at, filled = state
        joins = filled + size <= LARGEST and (size < TINY or filled < TINY)
        at, filled = (at, filled + size) if joins else (at + 1, size)
        return (at, filled), at

    return step


def modules(rows: DataFrame) -> DataFrame:
    """(file_id, module, declares, exports, dynamic_imports, size, statements, kind, score, confidence)."""
    joined = rows.filter("file_id is not null")
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    out = joined.groupBy("file_id", "module").agg(merged("declares"), merged("exports"), merged("dynamic_imports"), F.sum("size").alias("size"), F.count("*").alias("statements"), F.min("start").alias("start"))
    named = (F.size("declares") > 0).cast("double")
    score = BASE_SCORE + 0.25 * named + 0.2 * (F.size("exports") > 0).cast("double") + ENTRY_SCORE * (F.col("module") == 0).cast("double")
    score = F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.05), score)), 6)
    kind = F.when(F.col("module") == 0, "entry").when(F.size("exports") > 0, "public").otherwise("internal")
    return out.withColumn("kind", kind).withColumn("score", score).withColumn("confidence", scoring.confidence_label(F.col("score")))


def edges(rows: DataFrame) -> DataFrame:
    """(file_id, source, target, symbols): a use points to the first other module that declares the name.

    Declarations and uses of a file lie together, so that all is done by one shuffle.
    """
    marked = lambda c, declares: F.transform(c, lambda n: F.struct(n.alias("name"), F.lit(declares).alias("declares")))
    both = F.explode(F.concat(marked("declares", True), marked("uses", False)))
    names = rows.filter("file_id is not null").select("file_id", F.col("module").alias("source"), both.alias("n")).select("file_id", "source", "n.*")
    target = F.min(F.when(F.col("declares"), F.col("source"))).over(Window.partitionBy("file_id", "name"))
    found = spread(names, "file_id").withColumn("target", target).filter("not declares and source != target")
    return found.groupBy("file_id", "source", "target").agg(F.count_distinct("name").alias("symbols"))


def graph_summary(graph: DataFrame, found: DataFrame) -> DataFrame:
    total = graph.agg(F.count_distinct("file_id").alias("chunks"), F.count("*").alias("modules"), F.round(F.avg("score"), 6).alias("average_score"))
    return total.join(found.agg(F.count("*").alias("edges")))


def missing_imports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Dynamic imports whose target no file of the table has, with the number of statements."""
    wanted = rows.select(F.explode("dynamic_imports").alias("target")).withColumn("target", F.regexp_replace("target", r"^\./", ""))
    known = files.select(F.col("path").alias("_path")).distinct()
    counts = wanted.groupBy("target").agg(F.count("*").alias("statements"))
    return counts.join(known.hint("merge"), F.col("target") == F.col("_path"), "left_anti")
