"""Globs, catalog patterns and small text functions, as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_like(pattern: str) -> str:
    """A glob as a LIKE pattern: what LIKE knows is escaped first, then ``*`` and ``?`` translated."""
    for c in "\\%_":
        pattern = pattern.replace(c, "\\" + c)
    return pattern.replace("*", "%").replace("?", "_")


def matches_glob(c: Column, pattern: str) -> Column:
    """Without ``*`` and ``?``: equality. With: LIKE that ignores ASCII case."""
    return c.ilike(glob_to_like(pattern)) if "*" in pattern or "?" in pattern else c == pattern


def expand_braces(pattern: str) -> list[str]:
    """A pattern's alternatives: ``a.{b,c}`` is ``a.b`` and ``a.c``. Options lose outer blanks and may hold braces; an open brace is a letter."""
    made, option, held, depth = [""], "", [], 0
    for i, c in enumerate(pattern):
        if c == "{" and (depth or _closes(pattern, i)):
            depth += 1
            if depth == 1:
                continue
        elif c == "}" and depth:
            depth -= 1
        if depth == 1 and c == ",":
            held, option = [*held, option], ""
        elif depth:
            option += c
        elif c == "}" and (held or option or pattern[i - 1] in "{,"):
            inner = [x for o in (*held, option) for x in expand_braces(o.strip())]
            made, option, held = [m + x for m in made for x in inner], "", []
        else:
            made = [m + c for m in made]
    return list(dict.fromkeys(made))


def _closes(pattern: str, at: int) -> bool:
    """Whether the brace at a place has its other one."""
    depth = 0
    for c in pattern[at:]:
        depth += (c == "{") - (c == "}")
        if not depth:
            return True
    return False


def catalog_regex(pattern: str) -> str:
    """A catalog pattern as an anchored Java regex; case counts and ``*`` crosses dots."""
    out = []
    for alternative in expand_braces(pattern):
        part, i = "", 0
        while i < len(alternative):
            c = alternative[i]
            if c == "[" and (end := alternative.find("]", i + 2)) > 0:
                inside = alternative[i + 1 : end].replace("\\", "\\\\")
                part += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
                i = end
            else:
                part += {"*": ".*", "?": "."}.get(c) or re.escape(c)
            i += 1
        out.append(part)
    return "(?s)\\A(?:" + "|".join(out) + ")\\z"


def prefix_of(qname: Column) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(F.instr(qname, ":") > 0, F.split_part(qname, F.lit(":"), F.lit(1)))


def last_segment(qname: Column) -> Column:
    return F.regexp_extract(qname, "([^.:]*)$", 1)


def parent_qname(qname: Column) -> Column:
    return F.when(F.instr(qname, ".") > 0, F.regexp_replace(qname, "\\.[^.]*$", ""))


def first_string_arg(preview: Column) -> Column:
    """The first string literal of an argument preview, 128 characters at most; null without one."""
    found = F.regexp_extract(preview, "[\"']([^\"']*)[\"']", 1)
    return F.when(preview.rlike("[\"'][^\"']*[\"']"), F.substring(found, 1, 128))


#: What an argument list may hold and still be constant: literals, brackets, commas, and names of arguments before "=".
_CONSTANT = r"""^(?:[\s,=()\[\]{}:]|'[^']*'|"[^"]*"|`(?:[^`$]|\$(?!\{))*`|[0-9][0-9_.eExXaAbBcCdDfF]*|True|False|None|null|true|false|nil|[A-Za-z_][A-Za-z0-9_]*\s*=)*$"""


def constant_args(preview: Column) -> Column:
    """Whether a call's arguments are literals alone; none are, and a preview that was cut never is."""
    text = F.trim(F.coalesce(preview, F.lit("")))
    return ~(text.endswith("…") | text.endswith("...")) & text.rlike(_CONSTANT)


def truncate(c: Column, n: int = 80) -> Column:
    """White space made single, cut to ``n`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def compose_route(*parts: Column) -> Column:
    """Route parts joined by one slash, with one in front."""
    trimmed = [F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", "") for p in parts]
    kept = [F.when(t != "", t) for t in trimmed]
    return F.concat(F.lit("/"), F.concat_ws("/", *kept))


def route_params(route: Column) -> Column:
    """Names of ``:x``, ``*x``, ``{x}`` and ``<t:x>`` in a route, in order."""
    return F.regexp_extract_all(route, F.lit("[:*{<](?:[A-Za-z]+:)?([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))


def methods_of(text: Column) -> Column:
    """Upper-cased HTTP methods in a ``methods=[...]`` argument."""
    inside = F.regexp_extract(text, "methods\\s*=\\s*[\\[(]([^\\])]*)", 1)
    return F.transform(F.regexp_extract_all(inside, F.lit("[\"']([A-Za-z]+)[\"']"), F.lit(1)), F.upper)


def identifier_args(preview: Column) -> Column:
    inside = F.regexp_replace(preview, "^\\(|\\)$", "")
    return F.filter(F.transform(F.split(inside, ","), F.trim), lambda x: x.rlike("^[A-Za-z_][A-Za-z0-9_]*$"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def module_path(path: Column, language: Column) -> Column:
    """Dotted module of a file path: the extension goes, package files stand for their folder."""
    bare = F.regexp_replace(path, "\\.[A-Za-z]+$", "")
    dotted = F.when(language == "python", F.regexp_replace(bare, "(^|/)__init__$", "")).when(language.isin("javascript", "typescript", "tsx"), F.regexp_replace(bare, "/index$", "")).when(language == "rust", F.regexp_replace(F.regexp_replace(bare, "^src/", ""), "/mod$|^(?:lib|main)$", "")).when(language == "go", F.regexp_replace(bare, "/?[^/]*$", "")).otherwise(bare)
    return F.replace(dotted, F.lit("/"), F.lit("."))
