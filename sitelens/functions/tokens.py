"""Tokens of JavaScript text: the one place where strings, templates, comments and regular expressions are told apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Fixed values of the language: words that are never names, and those after which an operand follows.
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in"
    " instanceof let new null return static super switch this throw true try typeof var void while with yield".split()
)
EXPECTING = frozenset("await case delete do else extends in instanceof new of return throw typeof void yield".split())

#: A token with the white space before it, or the end.
_SPACED = re.compile(
    r"""\s*(?:(//[^\n]*|/\*.*?(?:\*/|\Z))|([^\W\d][\w$]*|\$[\w$]*)|(\.?\d[\w.]*)|("(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(=>|\.\.\.|\?\.(?!\d)|.)|\Z)""",
    re.S,
)
_KINDS = (None, "comment", "name", "number", "string", "mark")
_PATTERN = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\\\Z|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z)", re.S)

Token = tuple[str, str, int]


def ends_operand(token: Token | None) -> bool:
    """Whether an operand can end with a token, so that a slash after it divides."""
    if token is None:
        return False
    kind, text, _ = token
    return kind in ("number", "string") or (text not in EXPECTING if kind == "name" else text in (")", "]"))


def tokens(code: str, comments: bool = False) -> Iterator[Token]:
    """(kind, text, start) of names, numbers, strings, marks and, if wanted, comments.

    Regular expressions and the pieces of a template are strings; what a template embeds is
    given between the marks ``${`` and ``}``. Unclosed strings and comments end with the
    line or the text; nothing is refused.
    """
    found = []
    for m in _SPACED.finditer(code):
        k = m.lastindex
        if k is None or k == 1 and not comments:
            continue
        text = m[k]
        if text == "/" or text == "`":  # a slash may divide or begin a pattern, and templates nest
            return _stateful(code, comments)
        found.append((_KINDS[k], text, m.start(k)))
    return iter(found)


def _stateful(code: str, comments: bool) -> Iterator[Token]:
    """The tokens of code with slashes or templates, whose meaning depends on what stands before."""
    found, at, last, braces, depth = [], 0, None, [], 0
    heads, headed = [], False  # whether open parentheses, and the one closed last, are the head of a statement
    step, add = _SPACED.match, found.append
    while (k := (m := step(code, at)).lastindex) is not None:
        text, start, at = m[k], m.start(k), m.end()
        if k == 1:
            if comments:
                add(("comment", text, start))
            continue
        before, last = last, (_KINDS[k], text, start)
        if k != 5:
            add(last)
            continue
        if text == "/" and (not ends_operand(before) or headed and before[1] == ")") and (pattern := _PATTERN.match(code, start)):
            last, at = ("string", pattern[0], start), pattern.end()
        elif text == "(":
            heads.append(before is not None and before[1] in ("if", "while", "for", "with"))
        elif text == ")":
            headed = bool(heads) and heads.pop()
        elif text == "{":
            depth += 1
        elif text == "}" and not (braces and braces[-1] == depth):
            depth -= 1
        elif text in ("`", "}"):  # a template, or back into one
            if text == "}":
                braces.pop()
                add(last)
                start = at
            at = _TEMPLATE.match(code, at).end()
            opens = code.endswith("${", start, at)
            last = ("string", code[start : at - 2 if opens else at], start)
            if opens:
                add(last)
                last = ("mark", "${", at - 2)
                braces.append(depth)
        add(last)
    return iter(found)


def plain(code: str) -> str:
    """The code with comments, strings, templates' texts and regular expressions blanked, place for place."""
    out, at = [], 0
    for kind, text, start in tokens(code, comments=True):
        if kind in ("string", "comment"):
            out += [code[at:start], re.sub(r"[^\n]", " ", text)]
            at = start + len(text)
    return "".join([*out, code[at:]])
