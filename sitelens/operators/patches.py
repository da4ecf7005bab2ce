"""Patch plans: functions found by their balanced blocks, and actions that apply or say why not.

Named functions are stretches of a file that a token pass closes at the right brace. An
action replaces a snippet that must stand in its file exactly once; the first check that
fails is its reason. What passes becomes an edit, so actions that meet are refused too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.tokens import Token, tokens
from sitelens.operators import edits

FUNCTIONS = "file_id string, name string, start long, stop long, body_start long, body_stop long, depth long, text string, parameters array<string>"
#: Functions of a batch, about.
BATCH_ROWS = 5_000
_SPACE_AND_END = re.compile(r"\s*;?")
_HEADS = frozenset(("function", "const", "let", "var"))
_PAIRS = {"(": ")", "[": "]", "{": "}", "${": "}"}


def _parameters(t: list[Token], close: dict[int, int], head: int) -> list[str | None]:
    """The parameters in the parentheses at ``head``; null for one that is more than a name."""
    out, k, first = [], head + 1, head + 1
    while k <= close[head]:
        if k == close[head] or t[k][:2] == ("mark", ","):
            if k > first:
                out.append(t[first][1] if k == first + 1 and t[first][0] == "name" else None)
            first = k + 1
        k = close[k] + 1 if k != close[head] and k in close else k + 1
    return out


def functions_among(t: list[Token], code: str) -> list[tuple]:
    """(name, start, stop, body_start, body_stop, depth, text, parameters) of ``function f(..) {..}`` and ``const f = (..) => {..}`` among the tokens of code."""
    close, stack = {}, []
    for k, (kind, text, _) in enumerate(t):
        if kind == "mark" and text in _PAIRS:
            stack.append(k)
        elif kind == "mark" and text in ")]}" and stack and _PAIRS[t[stack[-1]][1]] == text:
            close[stack.pop()] = k
    word = lambda k: t[k][1] if 0 <= k < len(t) and t[k][0] != "string" else ""
    found = []
    for k, (kind, text, start) in enumerate(t):
        if text not in _HEADS or kind != "name" or word(k - 1) in (".", "?."):
            continue
        head = None
        if text == "function":
            name = k + 2 if word(k + 1) == "*" else k + 1
            head, arrow = name + 1, False
        elif text in ("const", "let", "var") and word(k + 2) == "=":
            name, arrow = k + 1, True
            head = k + 4 if word(k + 3) == "async" else k + 3
        if head is None or word(head) != "(" or head not in close:
            continue
        body = close[head] + (2 if arrow else 1)
        if word(body) != "{" or body not in close or arrow and word(body - 1) != "=>":
            continue
        inside = t[close[body]][2]
        stop = _SPACE_AND_END.match(code, inside + 1).end()
        found.append((t[name][1], start, stop, t[body][2] + 1, inside, code[start:stop], _parameters(t, close, head)))
    out, open_ = [], []
    for name, start, stop, a, b, text, parameters in found:  # in order of start: the open ones hold what follows
        while open_ and open_[-1] <= start:
            open_.pop()
        out.append((name, start, stop, a, b, len(open_), text, parameters))
        open_.append(stop)
    return out


def named_functions(files: DataFrame) -> DataFrame:
    """Rows of FUNCTIONS: every named function of a table with file_id and content, and how deep it nests.

    A stretch takes along white space and one semicolon after its closing brace. Braces in
    strings, templates, comments and regular expressions don't count; blocks that aren't
    closed, null and empty files have no rows.
    """
    types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    kinds = {n: types[k] for n, k in (c.split() for c in FUNCTIONS.split(", "))}

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held += [(key, *r) for r in functions_among(list(tokens(code or "")), code or "")]
                if len(held) >= BATCH_ROWS:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(run, FUNCTIONS)


def related_payloads(functions: DataFrame, payloads: DataFrame) -> DataFrame:
    """(file_id, name, start, symbol): payloads (file_id, symbol, evidence) of a function's file that its text names.

    A function that registers extra libraries is related to all payloads with evidence of types or editors.
    """
    mine = payloads.select(F.col("file_id").alias("_file"), "symbol", "evidence")
    registers = F.col("text").rlike(r"addExtraLib\s*\(") & F.exists("evidence", lambda e: e.rlike("type|declaration|editor"))
    met = functions.join(mine, F.col("file_id") == F.col("_file")).filter(F.contains(F.col("text"), F.col("symbol")) | F.coalesce(registers, F.lit(False)))
    return met.select("file_id", "name", "start", "symbol").distinct()


def distinct_actions(actions: DataFrame) -> DataFrame:
    """The first action, by action_id, of each (type, source_file, symbol, before_hash)."""
    key = [F.coalesce(F.col(c), F.lit("")) for c in ("type", "source_file", "symbol", "before_hash")]
    first = actions.groupBy(F.md5(F.concat_ws("\0", *key)).alias("_key")).agg(F.min("action_id").alias("_first"))
    return actions.join(first.select("_first"), F.col("action_id") == F.col("_first")).drop("_first")


def snippet_hash(text: Column) -> Column:
    """The first 16 hexadecimal digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def judged_actions(actions: DataFrame, files: DataFrame, locked: bool = False, prefix: str = "src/recovered-entry/", apart: bool = True) -> DataFrame:
    """Actions with ``reason`` (null: applies), ``start`` and ``stop`` of the snippet.

    actions has action_id, type, source_file, before, before_hash, after and symbol; files
    has path and content. All are held against the files as they stand. The reason is the
    first that holds: missing-exact-before-or-hash, plan-before-hash-mismatch,
    generated-entry-locked (below ``prefix``, if ``locked``), source-file-missing,
    exact-before-not-found, exact-before-not-unique, missing-exact-after, and, for what
    begins before an earlier snippet that applies ends, overlaps. Occurrences that overlap
    the first one don't count as second ones if they have to be ``apart``.
    """
    known = files.select(F.col("path").alias("_path"), F.coalesce("content", F.lit("")).alias("_content"))
    rows = actions.join(known, F.col("source_file") == F.col("_path"), "left")
    found = lambda start: F.call_function("locate", F.col("before"), F.col("_content"), start)
    rows = rows.withColumn("_at", found(F.lit(1)).cast("int"))
    rows = rows.withColumn("_again", F.when(F.col("_at") > 0, found(F.col("_at") + (F.length("before") if apart else 1))).otherwise(0))
    lost = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = (
        F.when(lost("source_file") | lost("before") | lost("before_hash"), "missing-exact-before-or-hash")
        .when(snippet_hash(F.col("before")) != F.col("before_hash"), "plan-before-hash-mismatch")
        .when(F.lit(locked) & F.startswith("source_file", F.lit(prefix)), "generated-entry-locked")
        .when(F.col("_path").isNull(), "source-file-missing")
        .when(F.col("_at") == 0, "exact-before-not-found")
        .when(F.col("_again") > 0, "exact-before-not-unique")
        .when(F.col("after").isNull(), "missing-exact-after")
    )
    start = F.when(F.col("_at") > 0, F.col("_at") - 1).cast("long")
    rows = rows.select(*actions.columns, reason.alias("_first"), start.alias("start"), (start + F.length("before")).alias("stop"))
    script = rows.filter("_first is null").select(F.col("source_file").alias("file_id"), F.col("action_id").cast("string").alias("edit_id"), "start", "stop", F.col("after").alias("replacement"))
    refused = edits.checked(script, files.select(F.col("path").alias("file_id"), "content")).filter("reason is not null")
    refused = refused.select(F.col("edit_id").alias("_edit"), F.col("file_id").alias("_of"), F.col("reason").alias("_second"))
    out = rows.join(refused, (F.col("action_id").cast("string") == F.col("_edit")) & (F.col("source_file") == F.col("_of")), "left")
    return out.select(*actions.columns, F.coalesce("_first", "_second").alias("reason"), "start", "stop")


def patched(files: DataFrame, judged: DataFrame) -> DataFrame:
    """Files (path, content) with the actions applied that have no reason against them."""
    script = judged.filter("reason is null").select(F.col("source_file").alias("file_id"), F.col("action_id").cast("string").alias("edit_id"), "start", "stop", F.col("after").alias("replacement"))
    return edits.spliced(files.withColumnRenamed("path", "file_id"), script).withColumnRenamed("file_id", "path")


def outcome_counts(judged: DataFrame) -> DataFrame:
    """(status, reason, actions): how many actions apply, and how many are skipped for each reason."""
    status = F.when(F.col("reason").isNull(), "applied").otherwise("skipped")
    return judged.groupBy(status.alias("status"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("actions"))
