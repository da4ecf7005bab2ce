"""Rebuilding package manifests: every field from the claim that comes first, the other claims kept as rows.

What a manifest may hold is a table of claims (project, section, name, value, rank, source):
the recovered manifest's own fields, packages inferred from evidence, and what a kind of
project needs. One mergeable aggregate decides each field; nothing is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.evidence import ANY_VERSION
from sitelens.operators.scoring import first_by

MANIFEST = "name string, version string, private boolean, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "scripts")
#: Where claims come from, the first before the others.
RECOVERED, EVIDENCE, TEMPLATE, TOOLING, DEFAULT = "recovered-manifest", "package-evidence", "react-template", "tooling", "default"
RANKS = {RECOVERED: 0, EVIDENCE: 1, TEMPLATE: 2, TOOLING: 3, DEFAULT: 4}
UNNAMED, FIRST_VERSION = "recovered-package", "0.0.0-recovered"
APP_SCRIPTS = {"dev": "vite", "build": "vite build", "preview": "vite preview"}
TYPE_CHECK = "tsc --noEmit"
NO_BUILD = 'echo "Recovered package: review sources and add the appropriate build step."'
PEERS = ("react", "react-dom")


def manifests(files: DataFrame) -> DataFrame:
    """(project, path, m) of the files (project, path, content) that are package.json and hold an object."""
    rows = files.filter(F.col("path").rlike(r"(?:^|/)package\.json\z")).select("project", "path", F.from_json("content", MANIFEST).alias("m"), F.trim("content").alias("_text"))
    return rows.filter(F.startswith("_text", F.lit("{")) & F.try_parse_json("_text").isNotNull()).drop("_text")


def chosen_manifest(found: DataFrame) -> DataFrame:
    """The manifest of each project: that at the root, else that of the shortest path, equal ones by name."""
    return first_by(found, ["project"], [F.col("path") != "package.json", F.length("path"), F.col("path")])


def _of_manifest(found: DataFrame, source: Column) -> DataFrame:
    """Claims of the entries of manifests' sections."""
    parts = [
        found.select("project", F.lit(section).alias("section"), F.explode(F.col(f"m.{section}")).alias("name", "value"), source.alias("source"), "path")
        for section in SECTIONS
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.filter(F.col("value").isNotNull())


def claims(projects: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(project, section, name, value, source, rank) of all that may stand in each project's manifest.

    projects has project, label, shared_root, framework, kind and typescript; packages has
    project, name, version, requested (array), resolution and confidence. Only the chosen
    manifest makes claims of its own. A package that is the project itself, is named by an
    ecosystem alone or has low confidence makes none; React is a peer of a package. A
    project without files or packages has the defaults.
    """
    best = chosen_manifest(manifests(files)).select(F.col("project").alias("_project"), "m", "path")
    rows = projects.join(best, F.col("project") == F.col("_project"), "left").drop("_project")
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    named = given(F.col("m.name"))
    fallback = F.coalesce(given(F.col("shared_root")), given(F.col("label")), F.lit(UNNAMED))
    rows = rows.withColumn("package", F.coalesce(named, fallback))
    claim = lambda section, name, value, source: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.alias("value"), source.alias("source"))
    of = lambda c: F.when(c.isNotNull(), RECOVERED).otherwise(DEFAULT)
    version = given(F.col("m.version"))
    lit = lambda text: F.lit(text)
    app, react, types = F.col("kind") == "react-app", F.col("framework") == "react", F.col("typescript")
    typed = F.col("m.scripts")["typecheck"].isNotNull()
    tool = lambda section, name, when, source=TOOLING: F.when(when, claim(section, name, lit(ANY_VERSION), lit(source)))
    fixed = [
        claim("manifest", "name", F.col("package"), of(named)),
        claim("manifest", "version", F.coalesce(version, lit(FIRST_VERSION)), of(version)),
        claim("manifest", "private", F.coalesce(F.col("m.private"), F.lit(True)).cast("string"), of(F.col("m.private"))),
        *(tool("dependencies", p, app & react, TEMPLATE) for p in PEERS),
        *(tool("devDependencies", p, app & react) for p in ("vite", "@vitejs/plugin-react")),
        tool("devDependencies", "typescript", types),
        *(tool("devDependencies", f"@types/{p}", types & react) for p in PEERS),
        *(F.when(app, claim("scripts", name, lit(value), lit(DEFAULT))) for name, value in APP_SCRIPTS.items()),
        F.when(~app & types, claim("scripts", "typecheck", lit(TYPE_CHECK), lit(DEFAULT))),
        F.when(~app & (~types | typed), claim("scripts", "build", lit(NO_BUILD), lit(DEFAULT))),
    ]
    own = rows.select("project", F.explode(F.array_compact(F.array(*fixed))).alias("c")).select("project", "c.*")
    recovered = _of_manifest(rows.filter(F.col("m").isNotNull()), F.lit(RECOVERED)).drop("path")
    known = rows.select(F.col("project").alias("_project"), "package", "framework", "kind")
    seen = packages.join(known, F.col("project") == F.col("_project")).filter((F.col("name") != F.col("package")) & (F.col("resolution") != "ecosystem") & (F.col("confidence") != "low"))
    peer = (F.col("framework") == "react") & (F.col("kind") == "npm-package") & F.col("name").isin(*PEERS)
    asked = F.coalesce("version", F.get("requested", F.lit(0)), F.lit(ANY_VERSION))
    inferred = seen.select("project", F.when(peer, "peerDependencies").otherwise("dependencies").alias("section"), "name", asked.alias("value"), F.lit(EVIDENCE).alias("source"))
    ranks = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return own.unionByName(recovered).unionByName(inferred).withColumn("rank", ranks[F.col("source")])


def reconstructed(found: DataFrame) -> DataFrame:
    """(project, section, name, value, source, rivals): the claim that stands for each field, and how many other values it met.

    The first by rank stands; among (dev) dependencies one that asks for a version comes
    before all that take any. Equal ranks go by value.
    """
    loose = F.col("section").isin("dependencies", "devDependencies") & (F.col("value") == ANY_VERSION)
    best = F.min_by(F.struct("value", "source"), F.struct(loose.alias("loose"), "rank", "value")).alias("best")
    one = found.groupBy("project", "section", "name").agg(best, F.count_distinct("value").alias("values"))
    return one.select("project", "section", "name", "best.*", (F.col("values") - 1).alias("rivals"))


def conflicts(files: DataFrame) -> DataFrame:
    """(project, section, name, value, path) of dependencies that a project's manifests, chosen or not, ask in several versions."""
    every = _of_manifest(manifests(files), F.lit(RECOVERED)).filter(F.col("section") != "scripts").drop("source")
    several = every.groupBy("project", "section", "name").agg(F.count_distinct("value").alias("n")).filter("n > 1").drop("n")
    return every.join(several, ["project", "section", "name"], "left_semi")
