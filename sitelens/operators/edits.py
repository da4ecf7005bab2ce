"""Edit scripts: replacements of stretches of files' texts, checked against each other and applied at once.

An edit replaces the code points [start, stop) of a file. Edits that overlap an earlier one
are found by a running maximum over the ends before them and are refused with a reason,
never dropped; what stands is spliced in one pass over the text. Renames of whole
identifiers become such edits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a rename passes over: strings and templates as a whole, which may span lines, and comments.
_PASSED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)""", re.S)
_IDENTIFIER = re.compile(r"[A-Za-z0-9_$]+")
EDITS = "file_id string, edit_id string, start long, stop long, replacement string"
LEAST_CONFIDENCE, MOST_RENAMES = 0.85, 80


def checked(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Edits with ``reason``: null for those that stand.

    The reasons are, the first that holds: ``no file``, ``no replacement`` (null),
    ``outside`` (null, negative, turned or beyond the text) and ``overlaps``: begins before
    an earlier edit of the file ends. Earlier is by start, stop and edit_id. Touching
    edits, and insertions at one place, stand beside each other.
    """
    sizes = files.select(F.col("file_id").alias("_file"), F.coalesce(F.length("content"), F.lit(0)).alias("_size"))
    rows = edits.join(sizes, F.col("file_id") == F.col("_file"), "left")
    inside = F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("stop")) & (F.col("stop") <= F.col("_size")), F.lit(False))
    reason = F.when(F.col("_file").isNull(), "no file").when(F.col("replacement").isNull(), "no replacement").when(~inside, "outside")
    rows = rows.withColumn("reason", reason)
    order = Window.partitionBy("file_id").orderBy("start", "stop", "edit_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("reason").isNull(), F.col("stop"))).over(order)
    overlaps = F.col("reason").isNull() & (F.col("start") < reach)
    return rows.withColumn("reason", F.when(overlaps, "overlaps").otherwise(F.col("reason"))).select(*edits.columns, "reason")


def spliced(files: DataFrame, standing: DataFrame) -> DataFrame:
    """Files with ``content`` changed by edits that don't overlap; files without edits, and all other columns, stay.

    A null content is an empty one where it is edited.
    """
    script = standing.groupBy(F.col("file_id").alias("_file")).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "edit_id", "replacement"))).alias("_script"))
    rows = files.join(script, F.col("file_id") == F.col("_file"), "left").drop("_file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            new = []
            for text, script in zip(rows_["content"], rows_["_script"]):
                if script is None:
                    new.append(text)
                    continue
                parts, at, text = [], 0, text or ""
                for e in script:
                    parts += [text[at : e["start"]], e["replacement"]]
                    at = e["stop"]
                new.append("".join([*parts, text[at:]]))
            yield rows_.assign(content=new).drop(columns="_script")

    return rows.mapInPandas(run, files.schema)


def _reached(script: list[tuple], size: int) -> tuple[list[tuple], list[str | None]]:
    """A file's edits (start, stop, edit_id, replacement) in their order, and what is against each, as ``checked`` says."""
    script, reach, reasons = sorted(script, key=lambda e: (e[0] is not None, e[0], e[1] is not None, e[1], e[2] is not None, e[2])), 0, []
    for start, stop, _, replacement in script:
        if replacement is None:
            reasons.append("no replacement")
        elif start is None or stop is None or not 0 <= start <= stop <= size:
            reasons.append("outside")
        else:  # one that overlaps counts as reached too
            reasons.append("overlaps" if start < reach else None)
            reach = max(reach, stop)
    return script, reasons


def _joined(text: str, standing: Iterable[tuple]) -> str:
    """A text with edits that don't overlap, in order, made."""
    parts, at = [], 0
    for start, stop, _, replacement in standing:
        parts += [text[at:start], replacement]
        at = stop
    return "".join([*parts, text[at:]])


def spliced_scripts(files: DataFrame) -> DataFrame:
    """(file_id, content, overlapping, refused) of files whose ``script``, an array of (start, stop, edit_id, replacement), is in their row.

    What ``checked`` and ``spliced`` do with tables of edits, in one pass where a file's edits come with it.
    The edits of a batch of files are held against each other together, as arrays.
    """
    kinds = [("file_id", pa.string()), ("content", pa.string()), ("overlapping", pa.int64()), ("refused", pa.int64())]
    script = F.sort_array(F.transform("script", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["edit_id"].alias("edit_id"), e["replacement"].alias("replacement"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            texts, scripts, files_ = batch.column(1).to_pylist(), batch.column(2), len(batch)
            sizes, counts = (pc.fill_null(c, 0).to_numpy().astype(np.int64) for c in (pc.utf8_length(batch.column(1)), scripts.value_lengths()))
            flat, which = scripts.flatten(), np.repeat(np.arange(files_), counts)
            start, stop = (pc.fill_null(flat.field(k), -1).to_numpy() for k in (0, 1))
            inside = flat.field(3).is_valid().to_numpy(zero_copy_only=False) & (start >= 0) & (start <= stop) & (stop <= sizes[which])
            base = which * (sizes.max() + 1)  # above all that is reached in the files before
            reach = np.maximum.accumulate(np.append(-1, base + np.where(inside, stop, 0)))[:-1] - base  # one that overlaps counts as reached too
            overlaps = inside & (start < reach)
            at = np.flatnonzero(inside & ~overlaps)
            made = list(zip(start[at].tolist(), stop[at].tolist(), repeat(None), flat.field(3).take(pa.array(at)).to_pylist()))
            standing = np.bincount(which[at], minlength=files_)
            ends = np.cumsum(standing)
            for k in np.flatnonzero(standing).tolist():
                texts[k] = _joined(texts[k] or "", made[ends[k] - standing[k] : ends[k]])
            columns = [batch.column(0), texts, np.bincount(which[overlaps], minlength=files_), counts - standing]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content", script.alias("script")).mapInArrow(run, "file_id string, content string, overlapping long, refused long")


def renamed_texts(files: DataFrame) -> DataFrame:
    """(file_id, content, report) of files whose ``asked``, an array of renames that are all to be made, is in their row.

    A rename is (rename_id, symbol, new_name, from, upto); report is an array of (rename_id,
    replacements, refused), one for each. What ``rename_edits``, ``checked`` and ``spliced``
    do with tables of renames, in one pass where a file's renames come with it.
    """
    one = pa.struct([("rename_id", pa.string()), ("replacements", pa.int64()), ("refused", pa.int64())])
    kinds = [("file_id", pa.string()), ("content", pa.string()), ("report", pa.list_(one))]
    parts = lambda a: F.struct(*[a[c].cast("string").alias(c) for c in ("rename_id", "symbol", "new_name")], *[a[c].cast("long").alias(c) for c in ("from", "upto")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, asked in zip(*[c.to_pylist() for c in batch.columns]):
                counts = {a["rename_id"]: [0, 0] for a in asked or ()}
                script = list(_places(text or "", asked or ()))
                edits, reasons = _reached([e for e, _ in script], len(text or ""))
                for (_, _, edit_id, _), reason in zip(edits, reasons):
                    counts[edit_id.rpartition("@")[0]][reason is not None] += 1
                new = _joined(text or "", (e for e, r in zip(edits, reasons) if r is None)) if None in reasons else text
                out.append((key, new, [{"rename_id": k, "replacements": a, "refused": b} for k, (a, b) in counts.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out) if out else [[]] * 3, kinds)], names=[n for n, _ in kinds])

    schema = "file_id string, content string, report array<struct<rename_id:string,replacements:long,refused:long>>"
    return files.select(F.col("file_id").cast("string").alias("file_id"), "content", F.transform("asked", parts).alias("asked")).mapInArrow(run, schema)


def _places(text: str, asked: list[dict]) -> Iterator[tuple[tuple, str]]:
    """((start, stop, edit_id, replacement), rename_id) of the places in a text that renames change."""
    by_name: dict[str, list] = {}
    for a in asked:
        by_name.setdefault(a["symbol"], []).append(a)
    code = _PASSED.sub(lambda m: " " * len(m[0]), text)
    for m in _IDENTIFIER.finditer(code):
        for a in by_name.get(m[0], ()):
            if (a["from"] is None or a["from"] <= m.start()) and (a["upto"] is None or m.end() <= a["upto"]):
                yield (m.start(), m.end(), f"{a['rename_id']}@{m.start()}", a["new_name"]), a["rename_id"]


def rename_edits(files: DataFrame, renames: DataFrame) -> DataFrame:
    """(file_id, edit_id, start, stop, replacement, rename_id): the places that renames change.

    A rename has file_id, rename_id, symbol and new_name, and takes the whole file or the
    code points from ``from`` up to ``upto``. Places are whole identifiers, members
    included, outside strings, templates and comments.
    """
    bound = lambda c: F.col(c).cast("long").alias(c)
    asked = renames.groupBy(F.col("file_id").alias("_file")).agg(F.collect_list(F.struct("rename_id", "symbol", "new_name", bound("from"), bound("upto"))).alias("asked"))
    rows = files.join(asked, F.col("file_id") == F.col("_file")).select("file_id", "content", "asked")
    names = [*(c.split()[0] for c in EDITS.split(", ")), "rename_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            found = []
            for key, text, asked in zip(rows_["file_id"], rows_["content"], rows_["asked"]):
                found += [(key, edit_id, start, stop, new, rename_id) for (start, stop, edit_id, new), rename_id in _places(text or "", asked)]
            yield pd.DataFrame(found, columns=names)

    return rows.mapInPandas(run, f"{EDITS}, rename_id string")


def is_selected(confidence: Column, risk: Column, least: float = LEAST_CONFIDENCE) -> Column:
    return (confidence >= least) & (risk == "low")


def selected_renames(candidates: DataFrame, least: float = LEAST_CONFIDENCE, most: int | None = MOST_RENAMES) -> DataFrame:
    """Candidates of low risk and enough confidence; the first by falling confidence, file and id, if ``most`` is given."""
    chosen = candidates.filter(is_selected(F.col("confidence"), F.col("risk"), least))
    return chosen if most is None else chosen.orderBy(F.desc("confidence"), "file_id", "rename_id").limit(most)


def applied_renames(files: DataFrame, candidates: DataFrame, least: float = LEAST_CONFIDENCE, most: int | None = MOST_RENAMES) -> tuple[DataFrame, DataFrame]:
    """The files with the selected renames applied, and (file_id, rename_id, replacements, refused) of each of these.

    Of two renames of one place the one of the lesser rename_id stands, the other's place
    counts as refused.
    """
    chosen = selected_renames(candidates, least, most)
    judged = checked(rename_edits(files, chosen), files)
    counts = judged.groupBy("file_id", "rename_id").agg(F.count_if(F.col("reason").isNull()).alias("replacements"), F.count("reason").alias("refused"))
    report = chosen.select("file_id", "rename_id").join(counts, ["file_id", "rename_id"], "left").fillna(0, ["replacements", "refused"])
    return spliced(files, judged.filter("reason is null").drop("reason")), report
