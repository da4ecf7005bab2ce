"""Filters over files, packages and plan rows as boolean Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import paths as P


def third_party(path: Column) -> Column:
    return path.rlike(r"(?:^|/)node_modules/")


def runtime_helper(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:webpack|rollup|parcel|vite)/")


def own_files(files: DataFrame) -> DataFrame:
    """Files that are neither third-party nor helpers; if there are none, all that aren't third-party."""
    own = files.filter(~third_party(F.col("path")))
    plain = own.filter(~runtime_helper(F.col("path")))
    return own if plain.isEmpty() else plain


#: Hints that are words of code or style, not packages.
STOP_HINTS = ("use", "strict", "default", "module", "exports", "require", "import", "object", "string", "number", "boolean", "function", "undefined", "children", "button", "input", "utf-8", "text", "true", "false", "null")


def package_hint(text: Column) -> Column:
    """Whether a literal may hint at a package: none of an ordered list of objections holds."""
    bad = (F.length(text) < 4) | (F.length(text) > 64) | text.rlike(r"^(?:[./#]|https?:|data:|blob:)") | text.rlike(r"^-?\d+(?:\.\d+)?(?:px|em|rem|vh|vw|%|s|ms|deg)?\z")
    bad = bad | F.lower(text).isin(*STOP_HINTS) | text.rlike(r"^[a-z]{2}-[A-Z]{2}\z")
    return F.coalesce(~bad & P.valid_package_name(text).isNotNull(), F.lit(False))


def size_gate(size: Column, inspect_first: Column, most_transform: int = 5 << 20, least_split: int = 300 << 10) -> Column:
    """preserve, risk or transform."""
    return F.when(size > most_transform, "preserve").when(inspect_first & (size >= least_split), "preserve").when(size >= least_split, "risk").otherwise("transform")


def transform_status(path: Column, readable: Column, excluded: Column) -> Column:
    able = P.has_extension(path, "js", "mjs", "cjs", "css", "html", "htm")
    return F.when(excluded, "excluded").when(~readable, "unreadable").when(~able, "passthrough").otherwise("transform")


def generated_metadata(path: Column) -> Column:
    return path.rlike(r"(?:^|/)(?:_manifest\.json|_index\.js|package-lock\.json|[^/]+\.map|[^/]+-(?:plan|report|stats)\.(?:json|md))\z")


def runtime_path(path: Column) -> Column:
    return path.rlike(r"(?i)(?:^|[/._-])(?:vendor|runtime|compiler|worker|wasm|effects?)(?:[/._-]|\z)")


def inside_root(path: Column) -> Column:
    """No prefix of the path climbs above where it starts, and it isn't absolute."""
    steps = F.transform(F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", ".")), lambda s: F.when(s == "..", -1).otherwise(1))
    lowest = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + s).alias("at"), F.least(a["low"], a["at"] + s).alias("low")))["low"]
    return (lowest >= 0) & ~path.rlike(r"^(?:/|\\|[A-Za-z]:)")


def search(text: str, *columns: Column) -> Column:
    """Case-insensitive substring over several columns; arrays are joined."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower()))


def apply_gate(plan: DataFrame, least_confidence: float, most: int, order: list[Column]) -> DataFrame:
    """Low-risk rows of enough confidence that don't touch recovered files, the first ``most`` in an order."""
    able = (F.col("confidence") >= least_confidence) & (F.col("risk") == "low") & (F.col("scope") != "recovered")
    return plan.filter(able).orderBy(*order).limit(most)


def admissible_dependency(name: Column, own: Column, resolution: Column, confidence: Column) -> Column:
    return (name != own) & (resolution != "ecosystem") & (confidence != "low")
