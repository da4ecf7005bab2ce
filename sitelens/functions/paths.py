"""Path, route and package-coordinate scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a package name, and names the platform itself takes.
PACKAGE_NAME = r"^(?:@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*\z"
BUILTINS = tuple(
    "assert buffer child_process cluster console constants crypto dgram dns domain events fs http http2 https inspector module net os "
    "path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls tty url util v8 vm wasi worker_threads zlib".split()
)


def sanitize_path(path: Column) -> Column:
    """Scheme off, forward slashes, characters illegal in file names as ``_``, no dot segments."""
    text = F.regexp_replace(path, r"^webpack:///?", "")
    text = F.regexp_replace(text, r"^file:///?", "")
    text = F.regexp_replace(text, r"^(?i)[a-z]+://", "")
    text = F.regexp_replace(F.translate(text, "\\", "/"), r'[<>:"|?*]', "_")
    segments = F.filter(F.split(text, "/+"), lambda s: ~s.isin("", ".", ".."))
    return F.when(F.size(segments) > 0, F.array_join(segments, "/")).otherwise(F.lit("unknown"))


def normalize_relative_path(path: Column) -> Column:
    """Dot segments resolved; a ``..`` takes back the segment before it, if any."""
    segments = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        start,
        lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, s)),
    )
    return F.array_join(kept, "/")


def dirname(path: Column) -> Column:
    return F.regexp_extract(normalize_relative_path(path), r"^(.*)/[^/]*\z", 1)


def basename(path: Column) -> Column:
    """Last segment without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[^.]+\z", "")


def resolve_relative_path(base: Column, reference: Column) -> Column:
    absolute = reference.rlike(r"^(?i)(?:[a-z]+:)?//") | reference.startswith("data:")
    return F.when(absolute, reference).otherwise(normalize_relative_path(F.concat_ws("/", F.nullif(dirname(base), F.lit("")), F.nullif(reference, F.lit("")))))


def slug(text: Column, otherwise: str = "item") -> Column:
    joined = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(joined == "", F.lit(otherwise)).otherwise(joined)


def route_of(path: Column) -> Column:
    """The route a static page answers."""
    plain = F.translate(path, "\\", "/")
    cut = F.when(plain.endswith("/index.html"), F.regexp_replace(plain, r"/index\.html\z", "")).otherwise(F.regexp_replace(plain, r"\.html\z", ""))
    return F.when(plain == "index.html", F.lit("/")).when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))


def valid_package_name(name: Column) -> Column:
    """The trimmed name, or null where it is no package name or the platform's own."""
    text = F.trim(name)
    return F.when(text.rlike(PACKAGE_NAME) & ~text.startswith("node:") & ~text.isin(*BUILTINS), text)


def package_of_specifier(specifier: Column) -> Column:
    """The package an import specifier names; null for relative, virtual and platform imports."""
    text = F.regexp_extract(F.trim(specifier), r"^([^?#]*)", 1)
    local = (text == "") | text.rlike(r"^(?:\.|/|#|~/|@/)") | text.rlike(r"^(?i)[a-z]+:")
    scoped = F.regexp_extract(text, r"^(@[^/]+/[^/]+)", 1)
    return F.when(~local, valid_package_name(F.when(text.startswith("@"), scoped).otherwise(F.substring_index(text, "/", 1))))


def package_of_path(path: Column) -> Column:
    """The package below the last ``node_modules`` of a path."""
    tail = F.regexp_extract(F.translate(path, "\\", "/"), r"^(?:.*/)?node_modules/+(.+)$", 1)
    found = F.regexp_extract(tail, r"^(@[^/]+/+[^/]+|[^/]+)", 1)
    return F.nullif(F.regexp_replace(found, "/+", "/"), F.lit(""))


def coordinate(reference: Column) -> Column:
    """(name, version, evidence) that a source reference gives away, or nulls."""
    text = F.regexp_replace(reference, r"^(?:webpack|rollup|vite)://", "")
    text = F.regexp_replace(text, r"^\.?/", "")
    rules = [
        ("source-map-node-modules", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/@]+)(?:/|$)", False),
        ("source-map-npm-coordinate", r"^npm:((?:@[^/]+/)?[^@/]+)@([^/]+)(?:/|$)", True),
        ("source-map-vite-dep", r"(?:^|/)\.vite/deps/((?:@[^/]+/)?[^.?/]+)(?:\.js|/|$)", False),
        ("source-map-cdn-coordinate", r"^https?://(?:[^/]*\.)?(?:unpkg|jsdelivr|esm\.sh|esm\.run|skypack)(?:\.[^/]*)?/(?:npm/)?((?:@[^/]+/)?[^@/]+)@([^/]+)(?:/|$)", True),
    ]
    out = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("evidence"))
    for kind, pattern, versioned in reversed(rules):
        name = F.regexp_extract(text, pattern, 1)
        name = valid_package_name(F.translate(name, "_", "/") if kind == "source-map-vite-dep" else name)
        version = F.regexp_extract(text, pattern, 2) if versioned else F.lit(None).cast("string")
        out = F.when(text.rlike(pattern), F.struct(name.alias("name"), version.alias("version"), F.lit(kind).alias("evidence"))).otherwise(out)
    return out


def glob_matches(path: Column, pattern: str) -> Column:
    """Anchored ``**`` and ``*``; a pattern without ``*`` is a substring."""
    if "*" not in pattern:
        return F.contains(path, F.lit(pattern))
    body = pattern.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")
    return path.rlike(rf"^{body}\z")


def has_extension(path: Column, *extensions: str) -> Column:
    return F.regexp_extract(F.lower(path), r"^[^?#]*", 0).rlike(rf"\.(?:{'|'.join(extensions)})\z")


def byte_size(n: Column) -> Column:
    """Human-readable bytes, powers of 1024, one decimal from KB on."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        scaled = F.round(n / F.lit(1024.0**power), 1).cast("decimal(20,1)").cast("string")
        out = F.when(n >= 1024**power, F.concat(scaled, F.lit(f" {unit}"))).otherwise(out)
    return out
