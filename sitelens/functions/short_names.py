"""Better names for single letters, from the members that they are asked for, as Column expressions.

Each rule names what a letter is if the code reads one of the rule's members from it. The
first rule that meets a letter decides, but for the caught errors, which overrule. Names
are given one after the other, each only if the text doesn't have it yet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.text import let

#: Members, and handlers, that tell what a letter is, in order; then its name.
RULES = [
    (r"\b(\w)\.(?:preventDefault|stopPropagation|target|currentTarget|clientX|clientY|pageX|pageY|key|keyCode|which|type|bubbles|detail)\b", "event"),
    (r"""\baddEventListener\(\s*["'][^"']+["']\s*,\s*(?:function\s*)?\((\w)\)""", "event"),
    (r"\.on\w+\s*=\s*(?:function\s*)?\((\w)\)", "event"),
    (
        r"\b(\w)\.(?:querySelector|querySelectorAll|classList|appendChild|removeChild|insertBefore|setAttribute|getAttribute|createElement|innerHTML|outerHTML|textContent"
        r"|parentElement|parentNode|childNodes|children|nextSibling|previousSibling|style|dataset|getBoundingClientRect|addEventListener|removeEventListener|dispatchEvent|closest"
        r"|matches|contains|cloneNode|focus|blur|scrollIntoView|offsetWidth|offsetHeight|offsetTop|offsetLeft|scrollTop|scrollLeft)\b",
        "element",
    ),
    (
        r"\b(\w)\.(?:getElementById|getElementsByClassName|getElementsByTagName|getElementsByName|documentElement|body|head|title|cookie|domain|referrer|readyState|createDocumentFragment)\b",
        "document",
    ),
    (r"\b(\w)\.(?:json|text|blob|arrayBuffer|ok|status|statusText|headers|redirected|url|body|bodyUsed)\(\)", "response"),
]
CAUGHT = r"catch\s*\((\w)\)\s*\{[^}]*\1\.(?:message|stack|name|cause)\b"
CALLED = r"^\s*\(\s*(?:\(\)\s*=>|function\s*\(\))\s*\{([\s\S]*)\}\s*\)\s*\(\s*\)\s*;?\s*\z"
ALIAS = r"(?m)^var\s+(\w)\s*=\s*([^;]+);[^\S\n]*$"
LONGEST_ALIAS = 200


def letter_names(code: Column) -> Column:
    """Array of (letter, name) in the order of their first rule and place; null code has none."""

    def met(pattern: str, name: str) -> Column:
        return F.transform(F.regexp_extract_all(code, F.lit(pattern), 1), lambda v: F.struct(v.alias("letter"), F.lit(name).alias("name")))

    every = F.concat(*[met(*rule) for rule in [*RULES, (CAUGHT, "error")]])

    def named(e: Column) -> Column:
        own = lambda v: F.filter(e, lambda x: x["letter"] == v)
        name = lambda o: F.when(F.exists(o, lambda x: x["name"] == "error"), "error").otherwise(F.get(o, 0)["name"])
        return F.transform(F.array_distinct(F.transform(e, lambda x: x["letter"])), lambda v: F.struct(v.alias("letter"), let(own(v), name).alias("name")))

    return F.coalesce(let(every, named), F.array().cast("array<struct<letter:string,name:string>>"))


def with_letter_names(code: Column, names: Column) -> Column:
    """The code with each letter's whole words replaced, in order, unless the text by then has the new name."""

    def step(text: Column, x: Column) -> Column:
        word = lambda w: F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E\b"))
        return F.when(F.rlike(text, word(x["name"])), text).otherwise(F.regexp_replace(text, word(x["letter"]), x["name"]))

    return F.aggregate(names, code, step)


def unwrapped(code: Column) -> Column:
    """What stands in a function that the whole text is a call of; else the text."""
    body = F.regexp_extract(code, CALLED, 1)
    return F.when(code.rlike(CALLED), body).otherwise(code)


def single_use_aliases(code: Column) -> Column:
    """Array of (letter, value, line) of the one-letter variables that a text names twice: where they are set, and once more."""
    part = lambda k: F.regexp_extract_all(code, F.lit(ALIAS), k)
    zipped = F.arrays_zip(part(1).alias("letter"), part(2).alias("value"), part(0).alias("line"))
    twice = lambda x: F.regexp_count(code, F.concat(F.lit(r"\b\Q"), x["letter"], F.lit(r"\E\b"))) == 2
    return F.filter(zipped, lambda x: twice(x) & (F.length(x["value"]) < LONGEST_ALIAS))


def inlined(code: Column, aliases: Column) -> Column:
    """The code with each alias's line taken out and its one use replaced by its value."""

    def step(text: Column, x: Column) -> Column:
        at = F.position(x["line"], text)
        rest = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(x["line"]), F.length(text)))).otherwise(text)
        pieces = F.split(rest, F.concat(F.lit(r"\b\Q"), x["letter"], F.lit(r"\E\b")), 2)
        return F.when(F.size(pieces) == 2, F.concat(F.get(pieces, 0), x["value"], F.get(pieces, 1))).otherwise(rest)

    return F.aggregate(aliases, code, step)
