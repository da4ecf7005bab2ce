"""Rename plans: better names for the short parameters of named functions.

What a parameter is likely to be comes from its function's name and text, by rules over
columns. The names are then given out so that no two live names meet: a greedy colouring in
order of confidence, in which a candidate conflicts with every name its function's stretch
holds and with the names given there before. Functions on the top don't overlap, so each
colours its own row, and one pass over a file's tokens is all that it takes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import text as X
from sitelens.functions.tokens import RESERVED, tokens
from sitelens.operators.patches import BATCH_ROWS, functions_among

#: What is added for a second occurrence, the most a confidence can be, and where risks begin.
USED_BONUS, MOST_CONFIDENCE, LOW_RISK, MEDIUM_RISK = 0.04, 0.96, 0.85, 0.72
SHORT = r"^[A-Za-z_$][\w$]?\z"
PLAN = "file_id string, rename_id string, function string, symbol string, suggested string, new_name string, confidence double, risk string, occurrences long, `from` long, upto long, line long"
TOP = "file_id string, function string, start long, stop long, line long, text string, parameters array<string>, held array<string>"


def inferred_parameter(function: Column, index: Column, count: Column, text: Column, words: Column | None = None) -> Column:
    """(name, confidence) of the parameter at ``index`` (from 0) of ``count``; the first rule that holds. ``words`` are the function's, if known."""
    words, lower = X.split_words(function) if words is None else words, F.lower(function)
    guess = lambda name, confidence: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), F.lit(confidence).alias("confidence"))
    noun = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    asks = (count == 1) & lower.rlike("^(?:is|has|should)")
    alone = count == 1
    fallback = F.coalesce(F.get(words, index), F.get(words, F.size(words) - 1))
    return (
        F.when(F.substring(text, 1, 120).rlike(r"(?i)\b(?:cb|callback)\b"), guess("callback", 0.9))
        .when(asks & noun.contains("specifier"), guess("specifier", 0.88))
        .when(asks & noun.contains("path"), guess("pathValue", 0.82))
        .when(asks, guess("value", 0.74))
        .when(alone & lower.contains("error"), guess("error", 0.86))
        .when(alone & lower.contains("number"), guess("value", 0.76))
        .when(alone & lower.contains("array"), guess(F.when(lower.contains("typed"), "typedArray").otherwise("items"), 0.8))
        .when(alone & lower.contains("path"), guess("pathValue", 0.76))
        .when(F.contains(text, F.lit("navigate(")) & (index == 1), guess("navigate", 0.82))
        .when(F.contains(text, F.lit(".catch(")) & (index == 0) & lower.contains("logout"), guess("logout", 0.86))
        .when(F.length(fallback) > 2, guess(fallback, 0.58))
    )


def _top_functions(files: DataFrame) -> DataFrame:
    """Rows of TOP: functions within no other, with the line they begin in and the names that their stretch holds."""
    types = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    kinds = {n: types[k] for n, k in (c.split() for c in TOP.split(", "))}

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for key, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = list(tokens(code or ""))
                at, line, seen = [start for *_, start in t], 1, 0
                for name, start, stop, _, _, depth, text, parameters in functions_among(t, code or ""):
                    if depth:
                        continue
                    line, seen = line + code.count("\n", seen, start), start
                    names = {word for kind, word, _ in t[bisect_left(at, start) : bisect_left(at, stop)] if kind == "name"}
                    held.append((key, name, start, stop, line, text, parameters, sorted(names)))
                if len(held) >= BATCH_ROWS:
                    yield pack(held)
                    held = []
        if held:
            yield pack(held)

    known = files.filter("file_id is not null")
    return known.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(run, TOP)


def _asked(files: DataFrame) -> DataFrame:
    """Rows of TOP with ``asked``, the candidates of each function by falling confidence, then by place."""
    found = _top_functions(files).filter(F.exists("parameters", lambda p: p.rlike(SHORT))).withColumn("words", X.split_words(F.col("function")))
    guess = lambda p, k: F.struct(k.alias("index"), p.alias("symbol"), inferred_parameter(F.col("function"), k, F.size("parameters"), F.col("text"), F.col("words")).alias("guess"))
    found = found.withColumn("guesses", F.transform("parameters", guess))

    def fit(x: Column) -> Column:
        name = x["guess"]["name"]
        return x["symbol"].rlike(SHORT) & name.rlike(r"^[A-Za-z_$][\w$]*\z") & ~name.isin(*sorted(RESERVED)) & ~F.array_contains(F.array_compact("parameters"), name) & (name != x["symbol"])

    found = found.withColumn("fit", F.filter("guesses", fit))
    pattern = lambda x: F.concat(F.lit(r"(?<!\w)\Q"), x["symbol"], F.lit(r"\E(?!\w)"))
    counted = lambda x: F.struct(x["index"].alias("index"), x["symbol"].alias("symbol"), x["guess"].alias("guess"), F.regexp_count("text", pattern(x)).cast("long").alias("occurrences"))
    found = found.withColumn("counted", F.transform("fit", counted))
    bonus = lambda x: F.when(x["occurrences"] >= 2, USED_BONUS).otherwise(0.0)
    sure = lambda x: F.round(F.least(F.lit(MOST_CONFIDENCE), x["guess"]["confidence"] + bonus(x)), 6)
    row = lambda x: F.struct((-sure(x)).alias("order"), x["index"].alias("index"), x["symbol"].alias("symbol"), x["guess"]["name"].alias("suggested"), x["occurrences"].alias("occurrences"))
    return found.withColumn("asked", F.array_sort(F.transform("counted", row))).select("file_id", "function", "start", "stop", "line", "held", "asked")


def _rows(each: DataFrame) -> DataFrame:
    """The columns of a plan from rows with one candidate a."""
    ident = F.concat_ws("/", F.lpad(F.col("start").cast("string"), 12, "0"), F.lpad(F.col("a.index").cast("string"), 3, "0"))
    each = each.withColumn("rename_id", ident).withColumn("confidence", -F.col("a.order"))
    risk = F.when(F.col("confidence") >= LOW_RISK, "low").when(F.col("confidence") >= MEDIUM_RISK, "medium").otherwise("high")
    return each.withColumn("risk", risk).select("*", "a.symbol", "a.suggested", "a.occurrences", F.col("start").alias("from"), F.col("stop").alias("upto"))


def candidates(files: DataFrame) -> DataFrame:
    """(file_id, rename_id, function, symbol, suggested, confidence, risk, occurrences, from, upto) of functions on the top.

    Only parameters that are mere short names have rows, and only where a rule gives an
    identifier that is no reserved word and no parameter of the function itself.
    """
    return _rows(_asked(files).withColumn("a", F.explode_outer("asked")).filter("a is not null")).select("file_id", "rename_id", "function", "symbol", "suggested", "confidence", "risk", "occurrences", "from", "upto")


def _given(asked: Column, held: Column) -> Column:
    """The names of a function's candidates, in their order: the suggested one, or that with the first number from 2 that is free."""

    def step(given: Column, a: Column) -> Column:
        free = lambda name: ~F.array_contains(held, name) & ~F.array_contains(given, name)
        numbered = F.transform(F.sequence(F.lit(2), F.size(held) + F.size(given) + 2), lambda n: F.concat(a["suggested"], n.cast("string")))
        name = F.when(free(a["suggested"]), a["suggested"]).otherwise(F.get(F.filter(numbered, free), 0))
        return F.concat(given, F.array(name))

    return F.aggregate(asked, F.array().cast("array<string>"), step)


def rename_plan(files: DataFrame) -> DataFrame:
    """Rows of PLAN: candidates with names that clash with nothing, given out by falling confidence, then by place.

    The rows are what edits.rename_edits takes. Null and empty files, and those without an id, have none.
    """
    found = _asked(files).withColumn("given", _given(F.col("asked"), F.col("held")))
    # Outer, as an inner one would have the optimizer ask for the size of the array first, and make it twice.
    each = found.select("*", F.posexplode_outer("asked").alias("at", "a")).filter("a is not null").withColumn("new_name", F.get("given", F.col("at")))
    return _rows(each).select(*[c.split()[0].strip("`") for c in PLAN.split(", ")])
