"""Sinks: JSON, TSV and HTML reports, plan pairs, package trees, split parts with their manifest."""

from __future__ import annotations

import html as entities

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a rendered report may hold; larger results are written as tables.
MOST_RENDERED = 5_000


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_tsv(df: DataFrame, path: str) -> None:
    """Arrays are joined by a comma and a space, other nested columns become JSON."""
    flat = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        flat.append((F.array_join(c.cast("array<string>"), ", ") if kind == "array" else F.to_json(c) if kind in ("struct", "map") else c).alias(f.name))
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def render_html(title: str, tables: dict[str, DataFrame]) -> str:
    """A report of small tables; one over the bound is refused rather than cut."""
    out = [f"<!DOCTYPE html><meta charset=utf-8><title>{entities.escape(title)}</title><h1>{entities.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(MOST_RENDERED + 1).collect()
        if len(rows) > MOST_RENDERED:
            raise ValueError(f"{name} has more than {MOST_RENDERED} rows; export it as a table")
        cell = lambda v: entities.escape("" if v is None else str(v))
        out.append(f"<h2>{entities.escape(name)}</h2><table><tr>{''.join(f'<th>{cell(c)}</th>' for c in df.columns)}</tr>")
        out += [f"<tr>{''.join(f'<td>{cell(v)}</td>' for v in r)}</tr>" for r in rows]
        out.append("</table>")
    return "\n".join(out)


def package_tree(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, content) of a rebuilt package: the source's text, else what was generated.

    outputs: (path, source_id, generated); sources: (file_id, content).
    """
    texts = sources.select(F.col("file_id").alias("_id"), F.col("content").alias("_text"))
    return outputs.join(texts, F.col("source_id") == F.col("_id"), "left").select("path", F.coalesce("_text", "generated", F.lit("")).alias("content"))


def write_parts(parts: DataFrame, path: str) -> DataFrame:
    """Write split parts by chunk and return the manifest: (chunk, file, bytes, lines)."""
    parts.write.mode("overwrite").partitionBy("chunk").parquet(path)
    lines = F.size(F.split("content", "\n", -1))
    return parts.select("chunk", "file", F.octet_length("content").alias("bytes"), lines.alias("lines"))
