"""Does what a source gives reach a sink inside a Python function: yes, no or unknown."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


@dataclass
class Facts:
    """Assignments and calls of one function body, by the root names they use."""

    assigns: list[tuple[frozenset, frozenset]] = field(default_factory=list)
    calls: list[tuple[str, frozenset, int, frozenset]] = field(default_factory=list)  # name, argument roots, line, assigned to
    complete: bool = True


def roots(node: ast.AST | None) -> frozenset:
    """Names on which an expression is built, callees left out."""
    if node is None:
        return frozenset()
    names = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)}
    return frozenset(names - {n.func.id for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)})


def function_facts(source: str, name: str) -> Facts | None:
    """Facts of the function ``name``; None if the source does not parse or has no such function."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    node = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name), None)
    if node is None:
        return None
    out = Facts()
    todo = list(reversed(node.body))
    while todo:
        n = todo.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            continue
        targets: frozenset = frozenset()
        if isinstance(n, ast.Assign):
            targets = frozenset().union(*(roots(t) for t in n.targets))
            out.assigns.append((targets, roots(n.value)))
        elif isinstance(n, (ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
            targets = roots(n.target)
            out.assigns.append((targets, roots(n.value) | (targets if isinstance(n, ast.AugAssign) else frozenset())))
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)):
            out.assigns.append((roots(n.target), roots(n.iter)))
        elif isinstance(n, ast.withitem) and n.optional_vars is not None:
            out.assigns.append((roots(n.optional_vars), roots(n.context_expr)))
        elif isinstance(n, ast.Call):
            args = frozenset().union(*(roots(a) for a in n.args), *(roots(k.value) for k in n.keywords), roots(n.func.value) if isinstance(n.func, ast.Attribute) else frozenset())
            out.calls.append((ast.unparse(n.func).rpartition(".")[2], args, n.lineno, frozenset()))
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            out.complete = False
        todo += reversed(list(ast.iter_child_nodes(n)))
    return out


def propagate(facts: Facts, seeds: set[str]) -> set[str]:
    """Names that the seeds reach through assignments, to a fixpoint."""
    tainted = set(seeds)
    for _ in range(len(facts.assigns) + 1):
        before = len(tainted)
        for targets, used in facts.assigns:
            if used & tainted:
                tainted |= targets
        if len(tainted) == before:
            break
    return tainted


def reaches(facts: Facts | None, seeds: set[str], sink: str, line: int | None = None) -> bool | None:
    """Whether an argument of ``sink`` is tainted; None where the facts cannot tell."""
    if facts is None:
        return None
    tainted = propagate(facts, seeds)
    at = [c for c in facts.calls if c[0] == sink and (line is None or c[2] == line)]
    if not at:
        return None
    if any(c[1] & tainted for c in at):
        return True
    return False if facts.complete else None


@F.pandas_udf(BooleanType())
def verdict(language: pd.Series, source: pd.Series, function: pd.Series, seeds: pd.Series, sink: pd.Series) -> pd.Series:
    """:func:`reaches` by row; null for languages other than Python."""
    out = [reaches(function_facts(s or "", f), set(x if x is not None else ()), k) if lang == "python" else None for lang, s, f, x, k in zip(language, source, function, seeds, sink)]
    return pd.Series(out, dtype="object")
