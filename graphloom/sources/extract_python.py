"""Facts of Python files: symbols, imports, references and bindings, by the standard parser."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = """path string, module string, parse_ok boolean,
symbols array<struct<kind: string, name: string, qname: string, parent: string, start_line: int, end_line: int, decorators: array<string>, bases: array<string>, docstring: string, is_exported: boolean>>,
imports array<struct<ordinal: int, module: string, name: string, alias: string, level: int>>,
refs array<struct<ordinal: int, kind: string, callee_text: string, callee_name: string, receiver: string, line: int, caller: string, arg_count: int, arg_preview: string, arg_idents: array<string>>>,
bindings array<struct<name: string, type_text: string, scope: string, kind: string>>"""


def module_of(path: str) -> str:
    parts = path.removesuffix(".py").removesuffix(".pyi").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def preview(args: list[str], limit: int = 80) -> str:
    text = " ".join(("(" + ", ".join(args) + ")").split())
    return text if len(text) <= limit else text[: limit - 1] + "…"


class _Walk(ast.NodeVisitor):
    def __init__(self, module: str):
        self.module, self.scopes = module, [("module", module)]
        self.symbols: list[tuple] = []
        self.imports: list[tuple] = []
        self.refs: list[tuple] = []
        self.bindings: list[tuple] = []

    @property
    def scope(self) -> tuple[str, str]:
        return self.scopes[-1]

    def _enter(self, node, kind: str) -> None:
        parent = self.scope[1]
        qname = f"{parent}.{node.name}"
        bases = [ast.unparse(b) for b in getattr(node, "bases", [])]
        decorators = [ast.unparse(d) for d in node.decorator_list]
        self.symbols.append((kind, node.name, qname, parent, node.lineno, node.end_lineno, decorators, bases, ast.get_docstring(node), not node.name.startswith("_")))
        for b in bases:
            self._ref("inherit", b, b.rpartition(".")[2], b.rpartition(".")[0] or None, node.lineno, qname, [], [])
        for d, text in zip(node.decorator_list, decorators):
            f = ast.unparse(d.func) if isinstance(d, ast.Call) else text
            self._ref("decorator", f, f.rpartition(".")[2], f.rpartition(".")[0] or None, d.lineno, qname, [], [])
        if kind in ("function", "method"):
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                if a.annotation is not None:
                    self.bindings.append((a.arg, ast.unparse(a.annotation), qname, "declared"))
        self.scopes.append((kind, qname))
        for child in node.body:
            self.visit(child)
        self.scopes.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._enter(node, "class")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self._enter(node, "method" if self.scope[0] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports.append((len(self.imports), a.name, None, a.asname or a.name.split(".")[0], 0))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.imports.append((len(self.imports), node.module or "", a.name, a.asname or a.name, node.level))

    def _ref(self, kind, text, name, receiver, line, caller, args, idents) -> None:
        self.refs.append((len(self.refs), kind, text, name, receiver, line, caller, len(args), preview(args), idents))

    def visit_Call(self, node: ast.Call) -> None:
        args = [ast.unparse(a) for a in node.args] + [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords]
        given = [a.id for a in [*node.args, *(k.value for k in node.keywords)] if isinstance(a, ast.Name)]
        f = node.func
        if isinstance(f, (ast.Name, ast.Attribute)):
            text = ast.unparse(f)
            self._ref("call", text, text.rpartition(".")[2], text.rpartition(".")[0] or None, node.lineno, self.scope[1], args, given)
        else:
            self._ref("dynamic_call", ast.unparse(f)[:80], "<dynamic>", None, node.lineno, self.scope[1], args, given)
        for name in given:
            self._ref("callback", name, name, None, node.lineno, self.scope[1], [], [])
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            if isinstance(target, ast.Name) and self.scope[0] in ("module", "class"):
                kind = "field" if self.scope[0] == "class" else "constant" if target.id.isupper() else "variable"
                self.symbols.append((kind, target.id, f"{self.scope[1]}.{target.id}", self.scope[1], node.lineno, node.end_lineno, [], [], None, not target.id.startswith("_")))
            if isinstance(node.value, ast.Call) and isinstance(node.value.func, (ast.Name, ast.Attribute)) and isinstance(target, (ast.Name, ast.Attribute)):
                text = ast.unparse(node.value.func)
                kind = "constructor" if text.rpartition(".")[2][:1].isupper() else "call_result"
                self.bindings.append((ast.unparse(target), text, self.scope[1], kind))
        self.generic_visit(node)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.bindings.append((ast.unparse(node.target), ast.unparse(node.annotation), self.scope[1], "field" if self.scope[0] == "class" else "declared"))
        self.generic_visit(node)


def facts(path: str, content: str | None) -> dict:
    """One file's row; a file that does not parse has its module alone."""
    module = module_of(path)
    w = _Walk(module)
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError):
        return {"path": path, "module": module, "parse_ok": False, "symbols": [], "imports": [], "refs": [], "bindings": []}
    for node in tree.body:
        w.visit(node)
    names = ("kind", "name", "qname", "parent", "start_line", "end_line", "decorators", "bases", "docstring", "is_exported"), ("ordinal", "module", "name", "alias", "level"), ("ordinal", "kind", "callee_text", "callee_name", "receiver", "line", "caller", "arg_count", "arg_preview", "arg_idents"), ("name", "type_text", "scope", "kind")
    lists = [[dict(zip(n, r)) for r in rows] for n, rows in zip(names, (w.symbols, w.imports, w.refs, w.bindings))]
    return {"path": path, "module": module, "parse_ok": True, **dict(zip(("symbols", "imports", "refs", "bindings"), lists))}


def extract(files: DataFrame) -> DataFrame:
    """One row of facts for every file of ``files`` (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([facts(p, c) for p, c in zip(b["path"], b["content"])], columns=["path", "module", "parse_ok", "symbols", "imports", "refs", "bindings"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)
