"""Names, literals and formats of script text as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def split_words(name: Column) -> Column:
    """Lower-case words of camel, snake, kebab or spaced names."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda w: w != "")


def _upper_first(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.length(word)))


def title_case(name: Column) -> Column:
    return F.array_join(F.transform(split_words(name), _upper_first), " ")


def camel_case(name: Column) -> Column:
    return F.array_join(F.transform(split_words(name), lambda w, k: F.when(k == 0, w).otherwise(_upper_first(w))), "")


def is_identifier(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_$][\w$]*\z")


def is_minified(name: Column) -> Column:
    """One or two characters, or a letter with digits."""
    return name.rlike(r"^(?:[A-Za-z_$][\w$]?|[A-Za-z_$]\d+)\z")


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; an empty needle has none."""
    left = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (left / F.length(needle)).cast("int")).otherwise(F.lit(0))


def line_ending(text: Column) -> Column:
    return F.when(text.contains("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n"))


def normalized_code(text: Column) -> Column:
    """Line feeds only, no trailing blanks, one final line feed."""
    unix = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t]+(?=\n|\z)", "")
    return F.concat(F.regexp_replace(unix, r"\n*\z", ""), F.lit("\n"))


def middle_elided(text: Column, most: int = 160) -> Column:
    half = (most - 3) // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit("..."), F.right(text, F.lit(half)))).otherwise(text)


def html_escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def export_aliases(block: Column) -> Column:
    """(local, exported) of an export block ``{ a as b, c }``."""
    inside = F.regexp_extract(block, r"\{([^}]*)\}", 1)
    items = F.filter(F.transform(F.split(inside, ","), lambda i: F.trim(i)), lambda i: i != "")
    local = lambda i: F.regexp_extract(i, r"^(\S+)", 1)
    alias = lambda i: F.regexp_extract(i, r"\s+as\s+(\S+)\z", 1)
    return F.transform(items, lambda i: F.struct(local(i).alias("local"), F.coalesce(F.nullif(alias(i), F.lit("")), local(i)).alias("exported")))


def large_literals(code: Column, least_bytes: int) -> Column:
    """String literals of at least so many bytes, quotes included."""
    found = F.regexp_extract_all(code, F.lit(r""""(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\])*+`"""), 0)
    return F.filter(found, lambda s: F.octet_length(s) >= least_bytes)


def header_lines(text: Column) -> Column:
    """Map of ``name: value`` lines, names in lower case; the last of a name wins, others are left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.rlike(r"^\s*[^:\s]+\s*:"))
    pairs = F.transform(lines, lambda s: F.struct(F.lower(F.trim(F.substring_index(s, ":", 1))).alias("n"), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("v")))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["n"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: p["n"] == n), -1)["v"]))


def parameter_name(body: Column, name: Column) -> Column:
    """What a parameter is likely to be, by how a function's body uses it; the first rule that holds."""

    def uses(pattern: str) -> Column:
        return F.rlike(body, F.concat(F.lit(r"(?<![\w$.])\Q"), name, F.lit(rf"\E{pattern}")))

    rules = [("event", r"\.(?:preventDefault|stopPropagation|target)\b"), ("error", r"\.(?:stack|message)\b"), ("items", r"\.(?:map|filter|forEach|length)\b"), ("element", r"\.(?:addEventListener|querySelector|classList)\b"), ("callback", r"\s*\("), ("options", r"\.[A-Za-z_$]")]
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(uses(pattern), label).otherwise(out)
    return out


#: What exported names hint at, in order.
EXPORT_HINTS = [
    ("routing", r"BrowserRouter|Routes|Route|Navigate|Link|useNavigate|useParams|useSearchParams"),
    ("react-runtime", r"React|jsxRuntime|reactExports|reactDom|createRoot|hydrateRoot|scheduler"),
    ("three-rendering", r"WebGLRenderer|PerspectiveCamera|OrthographicCamera|OrbitControls|Vector[234]|Matrix4|Scene|Mesh|THREE|Raycaster|ColorManagement"),
    ("cad-kernel", r"(?i)initOpenCascade|opencascade|OCCT|TopoDS|BRep|Manifold|solver|shapeToGeometry|kernel"),
    ("editor", r"EditorApp|CodeEditor|FileExplorer|ParamPanel|ViewPanel|ExportPanel|Monaco"),
    ("viewport", r"Canvas|Viewport|SceneConfigurator|ViewController|Grid|ControlsInteractionBridge"),
    ("state", r"Store|use[A-Z]\w*Store|createWithEqualityFn|atom|reducer"),
    ("app-shell", r"(?i)auth|share|project|FeatureFlag|Toast|Theme"),
]


def export_hints(names: Column) -> Column:
    """The hints that an array of exported names gives, in order; empty for none."""
    joined = F.array_join(F.filter(names, lambda n: n != ""), " ")
    return F.array_compact(F.array(*[F.when(joined.rlike(sign), F.lit(hint)) for hint, sign in EXPORT_HINTS]))
