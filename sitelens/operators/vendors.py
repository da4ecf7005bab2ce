"""How recovered packages are taken in: by the longest rule that their name begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.evidence import ANY_VERSION

#: Packages, and beginnings of package names, that are too heavy to be imported at once.
HEAVY_PACKAGES = (
    "@babel/standalone @babylonjs/core @react-three/drei @react-three/fiber @monaco-editor/react @typescript/vfs ace-builds babel codemirror"
    " monaco-editor monaco-editor-core prettier shiki three typescript vtk.js"
).split()
HEAVY_BEGINNINGS = "@babel/ @codemirror/ @monaco-editor/ @prettier/ @react-three/ @shikijs/ @typescript/ three/ vtk.js/".split()
HEAVY = "heavy vendor package"
DOWNGRADED = "auto-downgraded after build-check oversize: "


def heavy_rules(spark) -> DataFrame:
    """(rule, whole) of the fixed values; a whole rule is the entire name."""
    return spark.createDataFrame([(r, True) for r in HEAVY_PACKAGES] + [(r, False) for r in HEAVY_BEGINNINGS], "rule string, whole boolean")


def longest_beginning(rows: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """rows with ``rule``: the longest rule that the name begins with, or is if the rule is whole; null if there is none.

    Rules are met level by level as in a trie: a name is cut to each of the lengths that
    rules have, and the cuts are looked up by an equality join, which costs a row a length
    and no product. Null names have no rule.
    """
    lengths = sorted(r.n for r in rules.select(F.length("rule").alias("n")).distinct().collect())  # no more than a name is long
    names = rows.select(name).filter(F.col(name).isNotNull()).distinct()
    levels = F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")
    cuts = names.select(name, F.explode(F.filter(levels, lambda n: n <= F.length(name))).alias("n"))
    cuts = cuts.select(name, F.substring(F.col(name), F.lit(1), F.col("n")).alias("_cut"), "n")
    met = cuts.join(rules, F.col("_cut") == F.col("rule")).filter(~F.col("whole") | (F.length(name) == F.col("n")))
    best = met.groupBy(F.col(name).alias("_name")).agg(F.max_by("rule", "n").alias("rule"))
    return rows.join(best, F.col(name) == F.col("_name"), "left").drop("_name")


def adapter_policy(packages: DataFrame, mode: Column, rules: DataFrame) -> DataFrame:
    """packages (package, versions) with version, adapter_mode, build_check_import, reason and rule.

    Of metadata mode, a heavy rule, lazy mode and imports the first that holds decides; the
    version is the first of the array, or ``*``.
    """
    rows = longest_beginning(packages, "package", rules)
    heavy = F.col("rule").isNotNull()
    kind = F.when(mode == "metadata", "metadata").when(heavy | (mode == "lazy"), "lazy").otherwise("imports")
    reason = F.when(mode == "metadata", "metadata mode requested").when(heavy, HEAVY).when(mode == "lazy", "lazy mode requested").otherwise("static import mode requested")
    version = F.coalesce(F.get("versions", F.lit(0)), F.lit(ANY_VERSION))
    return rows.select(*packages.columns, version.alias("version"), kind.alias("adapter_mode"), (kind == "imports").alias("build_check_import"), reason.alias("reason"), "rule")


def downgraded(plan: DataFrame, oversize: Column) -> DataFrame:
    """A plan whose imports became lazy wherever ``oversize`` has a reason; all else stays."""
    now = oversize.isNotNull() & F.col("build_check_import")
    return plan.withColumns(
        {
            "adapter_mode": F.when(now, "lazy").otherwise(F.col("adapter_mode")),
            "reason": F.when(now, F.concat(F.lit(DOWNGRADED), oversize)).otherwise(F.col("reason")),
            "build_check_import": F.col("build_check_import") & ~now,
        }
    )
