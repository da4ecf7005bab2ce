"""Scores and roles of recovered parts: how ready a part is, whether to promote it, what a bundle is for.

Points, caps and thresholds are fixed values of the plans they make, kept in tables; a score
is one expression over a part's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.operators.ranges import innermost

#: What a part starts with, points for what it has, and the thresholds of the labels.
READY_START, READY_POINTS = 0.2, {"semantic": 0.2, "whole": 0.18, "runnable": 0.08, "candidate": 0.08, "declares": 0.06, "named": 0.1}
READY_LINES = ((1500, 0.12), (6000, 0.08))
READY_LABELS = ((0.72, "source-like"), (0.52, "review-needed"))
OPEN_RUNTIMES = ("domain-runtime", "render-runtime")
LIKELY_NAMES = r"(?i)exports\.js\z|app-routes|state-|context|models|router|canvas|editor"


def readiness(parts: DataFrame) -> DataFrame:
    """Add readiness, from 0.05 to 0.95, and its label.

    parts: file, lines, semantic, fragment, runnable, candidate, declarations (a count), exports
    (a count), runtime (the category that dominates, or null), embedded (of a runtime). Nulls
    count as not there, but a part is runnable unless it is known not to be.
    """
    p, yes = READY_POINTS, lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    size = F.lit(0.0)
    for most, points in reversed(READY_LINES):
        size = F.when((F.col("lines") > 0) & (F.col("lines") < most), points).otherwise(size)
    score = F.lit(READY_START) + yes(F.col("semantic"), p["semantic"]) + yes(~F.coalesce("fragment", F.lit(False)), p["whole"]) + yes(F.coalesce("runnable", F.lit(True)), p["runnable"]) + size
    score = score + yes(F.col("candidate"), p["candidate"]) + yes(F.col("declarations") > 0, p["declares"]) + yes(F.col("file").rlike(LIKELY_NAMES), p["named"])
    score = score + F.least(F.lit(0.12), F.coalesce("exports", F.lit(0)) / 100)
    score = score - F.when(F.col("runtime").isin(*OPEN_RUNTIMES), 0.04).when(F.col("runtime").isNotNull(), 0.14).otherwise(0.0) - yes(F.col("embedded"), 0.12)
    score = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), score)), 6)
    label = F.lit("preserve-first")
    for least, name in reversed(READY_LABELS):
        label = F.when(F.col("readiness") >= least, name).otherwise(label)
    return parts.withColumn("readiness", score).withColumn("label", label)


#: Points of each kind of part, points and penalties by count with their caps, by size, and caps of the score.
PART_POINTS = {"source-candidate": 80, "wrapper-candidate": 58, "runtime-wrapper": 28, "inspection-only": 4}
COUNT_POINTS = {"exports": (10, 30), "declarations": (2, 24), "imports": (3, 18), "globals": (-14, 45), "externals": (-2, 50), "runtimes": (-12, 30)}


def promotion(parts: DataFrame) -> DataFrame:
    """Add score (0 or more) and action.

    parts: file, lines, kind, exports, declarations, imports, globals, externals, runtimes (counts).
    Null counts are 0. A file named exports.js is a bridge, whose externals don't count.
    """
    bridge = F.col("file").rlike(r"(?:^|/)exports\.js\z")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in COUNT_POINTS}
    counted = n | {"externals": F.when(bridge, 0).otherwise(n["externals"])}
    score = F.lit(0)
    for kind, points in PART_POINTS.items():
        score = F.when(F.col("kind") == kind, points).otherwise(score)
    for c, (each, most) in COUNT_POINTS.items():
        score = score + (F.least(counted[c] * abs(each), F.lit(most)) if each > 0 else -F.least(counted[c] * abs(each), F.lit(most)))
    lines = F.coalesce(F.col("lines"), F.lit(0))
    score = score - F.when(lines > 2500, 20).when(lines > 1000, 8).when((lines < 8) & (n["exports"] == 0), 10).otherwise(0)
    caps = [((n["globals"] > 0) & (n["exports"] == 0), 48), (counted["externals"] > 12, 45), (lines > 2500, 55), (F.col("kind") == "inspection-only", 8)]
    for condition, most in caps:
        score = F.when(condition, F.least(score, F.lit(most))).otherwise(score)
    kind, worth = F.col("kind"), F.col("score")
    wrapped = ((n["globals"] > 0) | (n["externals"] > 0)) & ~kind.eqNullSafe("runtime-wrapper")
    action = (
        F.when(bridge, F.when(kind == "runtime-wrapper", "create-runtime-export-facade").otherwise("create-export-facade"))
        .when(kind == "inspection-only", "inspect-only")
        .when(wrapped, "create-scope-wrapper")
        .when((kind == "source-candidate") & (worth >= 70), "extract-module")
        .when((kind == "wrapper-candidate") & (worth >= 55), "create-scope-wrapper")
        .when(kind == "runtime-wrapper", "wrap-runtime-boundary")
        .otherwise("inspect-only")
    )
    return parts.withColumn("score", F.greatest(F.lit(0), score).cast("int")).withColumn("action", action)


#: What a bundle's path says about its role, in order; a component's address comes after the first two.
ROLE_SIGNS = [("client-router", "(?i)ClientRouter"), ("theme", "(?i)theme"), ("component-hydration", None), ("framework-runtime", r"(?i)(?:page|client)\.")]
VENDOR_SIGN = r"(?i)index\.[A-Za-z0-9]+\.js\z|commonjsHelpers"


def bundle_roles(files: DataFrame, pages: DataFrame, framework: str = "unknown") -> DataFrame:
    """(file_id, path, role, pages): what each script of a site is for, and how many pages link it.

    files: (file_id, path); pages: (page_id, html). Addresses meet paths without a leading slash.
    """
    plain = lambda c: F.regexp_replace(c, "^/", "")
    linked = pages.select("page_id", F.explode(F.array_distinct(H.linked_scripts(F.col("html")))).alias("url"))
    linked = linked.groupBy(plain(F.col("url")).alias("_linked")).agg(F.count_distinct("page_id").alias("pages"))
    hydrated = H.island_rows(pages.select("html")).select(plain(F.col("url")).alias("_hydrated")).distinct()
    rows = files.withColumn("_plain", plain(F.col("path")))
    rows = rows.join(linked.hint("merge"), F.col("_plain") == F.col("_linked"), "left").join(hydrated.hint("merge"), F.col("_plain") == F.col("_hydrated"), "left")
    role = F.when(F.col("pages") > 0, "page-script").otherwise("unknown")
    role = F.when((F.lit(framework) == "astro") & F.col("path").rlike(VENDOR_SIGN), "vendor").otherwise(role)
    for name, sign in reversed(ROLE_SIGNS):
        role = F.when(F.col("path").rlike(sign) if sign else F.col("_hydrated").isNotNull(), name).otherwise(role)
    return rows.select("file_id", "path", role.alias("role"), F.coalesce("pages", F.lit(0)).alias("pages"))


#: Where a part belongs by its words, in order: what is looked through, its signs, what its file must not say, the place and how sure it is.
BUCKETS = [
    ("ids roles", "cad-kernel|domain-bridge", None, "src/cad-kernel", 0.9),
    ("ids roles categories file", "typescript|compiler|monaco|babel", None, "src/compiler-runtime", 0.88),
    ("ids roles categories", "wasm|emscripten|opencascade|manifold|solver", None, "src/wasm", 0.86),
    ("text", "react|router|effect|scheduler|vendor-react|vendor-boundaries", None, "src/vendor-boundaries", 0.78),
    ("text", "import|sandbox|compile|execution|log|model-runtime|forge", "vendor-typescript|compiler", "src/model-runtime", 0.66),
    ("text", "worker|evalworker", None, "src/workers", 0.72),
    ("text", "three|viewport|camera|orbit|canvas|render|scene", None, "src/viewport", 0.68),
    ("text", "cad|kernel|shape|geometry|occt|manifold|mesh|sketch|model", None, "src/cad-kernel", 0.62),
    ("text", "editor|code|highlight|javascript", None, "src/editor", 0.58),
    ("text", "runtime|vendor", None, "src/vendor-boundaries", 0.55),
]
OTHER_BUCKET = ("src/app", 0.5)


def structure(parts: DataFrame) -> DataFrame:
    """Add bucket and bucket_confidence.

    parts: file, entry, names (declared and exported), signals, an array of (id, role, category).
    Nulls have no words; the first rule of the list that holds decides.
    """
    joined = lambda field: F.array_join(F.transform("signals", lambda s: s[field]), " ")
    sources = {"ids": joined("id"), "roles": joined("role"), "categories": joined("category"), "file": F.col("file")}
    sources["text"] = F.concat_ws(" ", "file", "entry", F.array_join("names", " "), *[sources[c] for c in ("ids", "roles", "categories")])
    place, sure = F.lit(OTHER_BUCKET[0]), F.lit(OTHER_BUCKET[1])
    for where, signs, but, bucket, confidence in reversed(BUCKETS):
        text = F.lower(F.concat_ws(" ", *[sources[c] for c in where.split()]))
        holds = text.rlike(signs) if but is None else text.rlike(signs) & ~F.lower(F.coalesce("file", F.lit(""))).rlike(but)
        place, sure = F.when(holds, bucket).otherwise(place), F.when(holds, confidence).otherwise(sure)
    return parts.withColumn("bucket", place).withColumn("bucket_confidence", sure)


#: Whose a part is by its runtime signals, in order, and what to do with it.
OWNERS = [
    ("emscripten|wasm", "WASM/runtime bridge", "wrap-runtime-boundary"),
    ("react|reconciler|framework", "framework/vendor runtime", "wrap-or-replace-vendor"),
    ("three|render|viewport", "render/vendor runtime", "wrap-or-replace-vendor"),
    ("compiler|typescript|babel|monaco|worker", "compiler/editor/worker runtime", "preserve-or-replace-runtime"),
    ("", "runtime-signaled code", "review-runtime-boundary"),
]
INSPECTED = ("inspection-only runtime/vendor fragment", "preserve-for-inspection")
UNOWNED = ("unknown/app-candidate", "inspect-for-app-owned-boundary")


def ownership(parts: DataFrame) -> DataFrame:
    """Add owner and handling. parts: fragment, runnable, signals as for structure; no signals is an empty or null array."""
    ids = F.lower(F.array_join(F.array_distinct(F.transform("signals", lambda s: s["id"])), " "))
    some = F.coalesce(F.size("signals"), F.lit(0)) > 0
    owner, handling = F.lit(UNOWNED[0]), F.lit(UNOWNED[1])
    for signs, name, action in reversed(OWNERS):
        holds = some & ids.rlike(signs)
        owner, handling = F.when(holds, name).otherwise(owner), F.when(holds, action).otherwise(handling)
    set_aside = F.coalesce("fragment", F.lit(False)) | ~F.coalesce("runnable", F.lit(True))
    return parts.withColumn("owner", F.when(set_aside, INSPECTED[0]).otherwise(owner)).withColumn("handling", F.when(set_aside, INSPECTED[1]).otherwise(handling))


#: Packages that a recovered project is cut into, and the dependencies each may have.
PACKAGES = [
    ("app-shell", ("react", "react-dom", "react-router-dom", "@react-three/fiber", "three")),
    ("compiler-runtime", ()),
    ("bundler-runtime", ()),
    ("wasm-runtime", ()),
    ("worker-runtime", ()),
    ("framework-runtime", ("react", "react-dom")),
    ("editor", ("react", "react-dom", "monaco-editor", "highlight.js")),
    ("viewport", ("react", "@react-three/fiber", "three", "leva")),
    ("cad-kernel", ("three",)),
    ("model-project", ()),
    ("support", ()),
]
#: What an asset's name says about its package's status, in order.
STATUS_SIGNS = [
    (r"(?i)vendor-(?:typescript-compiler|babel-standalone|prettier-standalone|monaco-editor)", "inspection-fragments"),
    (r"(?i)runtime-|worker-runtime|wasm-runtime|bundler-runtime", "preserved-runtime"),
    (r"(?i)evalWorker|cameraState", "preserved-runtime"),
]


def package_boundaries(assets: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(position, package, assets, best, deps, status): one row for each package, in order.

    assets: (asset, package, score), of which a package that isn't listed counts as support;
    dependencies: (name). Of support there is a row only if it has assets. deps are those of
    the package that were detected, in the package's order.
    """
    spark = assets.sparkSession
    listed = spark.createDataFrame([(k, name, list(deps)) for k, (name, deps) in enumerate(PACKAGES)], "position int, package string, wanted array<string>")
    key = F.when(F.col("package").isin([name for name, _ in PACKAGES]), F.col("package")).otherwise("support")
    marks = [F.max(F.col("asset").rlike(sign)).alias(f"_sign{k}") for k, (sign, _) in enumerate(STATUS_SIGNS)]
    held = assets.groupBy(key.alias("_package")).agg(F.count("*").alias("assets"), F.max("score").alias("best"), *marks)
    rows = listed.join(held, F.col("package") == F.col("_package"), "left").filter((F.col("assets") > 0) | (F.col("package") != "support"))
    wanted = rows.select("position", F.posexplode("wanted").alias("at", "name")).join(dependencies.select("name").distinct(), "name", "left_semi")
    deps = wanted.groupBy(F.col("position").alias("_position")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda d: d["name"]).alias("deps"))
    status = F.lit("coarse-split")
    for k, (_, name) in reversed(list(enumerate(STATUS_SIGNS))):
        status = F.when(F.col(f"_sign{k}"), name).otherwise(status)
    out = rows.join(deps, F.col("position") == F.col("_position"), "left")
    return out.select("position", "package", F.coalesce("assets", F.lit(0)).alias("assets"), "best", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"), status.alias("status"))


#: How a script places a binary module's file, and how it starts the module.
LOCATES = r"locateFile\s*[:=]\s*(?:function|\([^)]*\)\s*=>|[A-Za-z_$][\w$]*)"
INSTANTIATES = r"WebAssembly\.(?:instantiate|compile)"


def wasm_contracts(files: DataFrame) -> DataFrame:
    """(wasm, file, locates, instantiates, specificity): binary modules with the scripts that name them.

    files: (path, content). Of modules of one name, the one below ``public`` counts, else the
    first path. Scripts meet modules on the names they mention, so no pair is tried in vain.
    """
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    public = ~F.col("path").rlike("(?:^|/)public/")
    modules = files.filter(F.lower("path").endswith(".wasm")).groupBy(name.alias("_name")).agg(F.min_by("path", F.struct(public, F.col("path"))).alias("wasm"))
    text = F.col("content")
    locates, instantiates = text.rlike(LOCATES), text.rlike(INSTANTIATES)
    scripts = files.filter(F.lower("path").rlike(r"\.(?:js|mjs|cjs)\z"))
    mentioned = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w.$~-]+\.wasm)\b"), 1))
    named = scripts.select(F.col("path").alias("file"), locates.alias("locates"), instantiates.alias("instantiates"), F.explode(mentioned).alias("_mention"))
    specificity = 4 + F.when(F.col("locates"), 2).otherwise(0) + F.when(F.col("instantiates"), 1).otherwise(0)
    return named.join(modules, F.col("_mention") == F.col("_name")).select("wasm", "file", "locates", "instantiates", specificity.alias("specificity"))


#: Names of helpers, components and dependencies that a focused extraction looks for, and how many it lists.
HELPER_NAMES = r"^(?:is|has|get|set|normalize|collect|build|derive|format|match|confirm|key|pluralize|smart|wait)|^[A-Z0-9_]+\z"
COMPONENT_NAMES = r"^[A-Z][A-Za-z0-9_$]*\z"
KEPT_NAMES = r"^(?:reactExports|jsxRuntimeExports|React|use[A-Z]|authFetch|showToast|fileSystem|navigate|window|document|navigator|URL|Blob|CSS|confirm)\z"
MOST_NAMES, MOST_KEPT = 24, 32


def focus_packets(candidates: DataFrame, focus: str) -> DataFrame:
    """(file, first_line, last_line, helpers, components, kept) of the files whose candidates match a word.

    candidates: file, at (their order), first_line, last_line, declarations, externals (arrays).
    Names stand in the order they are first seen.
    """
    told = F.contains(F.lower(F.concat_ws(" ", "file", F.array_join("declarations", " "))), F.lit(focus.lower()))
    names = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce(c, F.array().cast("array<string>")).alias("names")))), lambda x: x["names"])))
    rows = candidates.filter(told).groupBy("file").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), names("declarations").alias("_declared"), names("externals").alias("_external")
    )
    named = lambda c, sign, most: F.slice(F.filter(c, lambda n: n.rlike(sign)), F.lit(1), F.lit(most))
    return rows.select("file", "first_line", "last_line", named("_declared", HELPER_NAMES, MOST_NAMES).alias("helpers"), named("_declared", COMPONENT_NAMES, MOST_NAMES).alias("components"), named("_external", KEPT_NAMES, MOST_KEPT).alias("kept"))


#: Outputs of so many files with a larger share of tiny ones, files of so few lines, and the least share of source-like files.
MANY_FILES, TINY_SHARE, TINY_FILE_LINES, SOURCE_SHARE = 100, 0.25, 3, 0.35


def audit(parts: DataFrame) -> DataFrame:
    """(code, severity, priority, n): the warnings that hold for a table of split parts, by priority.

    parts: output, lines, candidate, fragment, exports (a count). n is how many outputs or parts
    the warning is about. Null flags count as no, null counts as 0.
    """
    candidate, fragment = F.coalesce("candidate", F.lit(False)), F.coalesce("fragment", F.lit(False))
    tiny = candidate & ~fragment & (F.coalesce("lines", F.lit(0)) <= TINY_FILE_LINES) & (F.coalesce("exports", F.lit(0)) == 0)
    outputs = parts.groupBy("output").agg(F.count("*").alias("files"), F.count_if(tiny).alias("tiny"), F.count_if(candidate & ~fragment).alias("sources"), F.count_if(fragment).alias("fragments"))
    noisy = (F.col("files") >= MANY_FILES) & (F.col("tiny") / F.col("files") > TINY_SHARE)
    total = outputs.agg(F.count_if(noisy).alias("noisy"), F.coalesce(F.sum("fragments"), F.lit(0)).alias("fragments"), F.coalesce(F.sum("sources"), F.lit(0)).alias("sources"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))
    warning = lambda holds, code, severity, priority, n: F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(priority).alias("priority"), n.cast("long").alias("n")))
    found = [
        warning(F.col("fragments") > 0, "preserved-runtime-fragments", "info", 2, F.col("fragments")),
        warning(F.col("noisy") > 0, "many-tiny-helper-modules", "info", 3, F.col("noisy")),
        warning((F.col("files") > 0) & (F.col("sources") / F.col("files") < SOURCE_SHARE), "low-source-candidate-ratio", "warning", 1, F.col("sources")),
    ]
    return total.select(F.explode(F.array_compact(F.array(*found))).alias("w")).select("w.*").orderBy("priority", "code")


def rolled_together(parts: DataFrame, plans: dict[str, DataFrame | None]) -> DataFrame:
    """(file_id, part, in_parts) with ``has_`` and ``n_`` of each plan: optional plans met on the spans of parts.

    parts has file_id, part, start and stop; a plan's rows have file_id and at, and belong to
    the innermost part of their file that spans them. An absent plan (None) counts nowhere;
    rows outside all parts are their file's row with a null part. It is one aggregate over
    the union of all plans, so that any of them may be missing or hold files of its own.
    """
    rows = [parts.select("file_id", "part", F.lit("").alias("plan"))]
    for name, plan in plans.items():
        if plan is not None:
            placed = innermost(plan.select("file_id", "at"), parts, ["file_id"], "at", "start", "stop", ["part"])
            rows.append(placed.select("file_id", "part", F.lit(name).alias("plan")))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    counts = [F.count_if(F.col("plan") == name).alias(f"n_{name}") for name in plans]
    out = every.groupBy("file_id", "part").agg(F.count_if(F.col("plan") == "").alias("_own"), *counts)
    return out.select("file_id", "part", (F.col("_own") > 0).alias("in_parts"), *[c for name in plans for c in ((F.col(f"n_{name}") > 0).alias(f"has_{name}"), f"n_{name}")])
