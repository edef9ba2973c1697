"""Python source to graph rows, with the standard library's parser.

Classes, functions and upper-case constants at module and class level become nodes; deeper
definitions belong to the function around them. Edges whose target is a name as written carry
unresolved=True.
"""

from __future__ import annotations

import ast
import builtins
from dataclasses import dataclass, field

import xxhash

_BUILTIN = frozenset(dir(builtins))
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.Match, ast.match_case)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


@dataclass
class Extract:
    """nodes: dicts of node columns; edges: (source, rel, target, unresolved)."""

    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str, str, bool]] = field(default_factory=list)


def digest(data: bytes) -> str:
    """Sixteen hexadecimal digits of XXH64, seed 0."""
    return xxhash.xxh64(data).hexdigest()


def shape(tree: ast.AST) -> str:
    """A digest of the tree's kinds of nodes; identifiers and literals don't matter."""
    out: list[str] = []
    stack: list[ast.AST | None] = [tree]
    while stack:
        n = stack.pop()
        if n is None:
            out.append(")")
            continue
        out.append("_" if isinstance(n, ast.Constant | ast.Name) else type(n).__name__ + "(")
        if not isinstance(n, ast.Constant | ast.Name):
            stack.append(None)
            stack.extend(reversed([c for c in ast.iter_child_nodes(n) if not isinstance(c, ast.expr_context)]))
    return digest("".join(out).encode())


def measure(tree: ast.AST) -> dict[str, int]:
    """Complexities, nesting, returns, lines and parameters of a function; nested definitions don't count."""
    cc, cognitive, deepest, returns = 1, 0, 0, 0
    stack: list[tuple[ast.AST, int, bool]] = [(tree, 0, False)]
    while stack:
        node, depth, _ = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (*_DEFS, ast.ClassDef)):
                continue
            elif_ = isinstance(child, ast.If) and isinstance(node, ast.If) and child in node.orelse and len(node.orelse) == 1 and child.col_offset == node.col_offset
            if isinstance(child, _BRANCHES):
                cc += 1
                cognitive += 1 + depth
            if isinstance(child, ast.BoolOp):
                cc += len(child.values) - 1
                cognitive += len(child.values) - 1
            returns += isinstance(child, ast.Return)
            inner = depth + (isinstance(child, _NESTS) and not elif_)
            deepest = max(deepest, inner)
            stack.append((child, inner, elif_))
    a = getattr(tree, "args", None)
    parameters = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg) if a else 0
    lines = tree.end_lineno - tree.lineno + 1  # type: ignore[attr-defined]
    return {"cyclomatic_complexity": cc, "cognitive_complexity": cognitive, "max_nesting_depth": deepest, "lines_of_code": lines, "parameter_count": parameters, "return_count": returns}


def dotted(e: ast.expr) -> str | None:
    parts = []
    while isinstance(e, ast.Attribute):
        parts.append(e.attr)
        e = e.value
    return ".".join([e.id, *reversed(parts)]) if isinstance(e, ast.Name) else None


def _relative(module: str, level: int, target: str | None, package: bool) -> str:
    base = module.split(".")
    base = base[: len(base) - level + package] if level else []
    return ".".join([*base, *([target] if target else [])])


class _Walk:
    def __init__(self, source: bytes, path: str, module: str):
        self.out, self.source, self.path, self.module = Extract(), source, path, module
        self.lines = source.splitlines(keepends=True)
        self.package = path.endswith("__init__.py")
        self.alias: dict[str, str] = {}

    def node(self, name: str, kind: str, n: ast.stmt, doc: str | None = None, metrics: dict | None = None) -> None:
        body = b"".join(self.lines[n.lineno - 1 : n.end_lineno])
        self.out.nodes.append({"name": name, "type": kind, "file": self.path, "line": n.lineno, "end_line": n.end_lineno, "docstring": doc, "content_hash": digest(body), "structure_hash": shape(n), "metrics": metrics, "cc": metrics and metrics["cyclomatic_complexity"]})

    def edge(self, source: str, rel: str, target: str, unresolved: bool = False) -> None:
        if (e := (source, rel, target, unresolved)) not in self.out.edges:
            self.out.edges.append(e)

    def imports(self, tree: ast.AST) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.edge(self.module, "imports", a.name, True)
                    self.alias[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(n, ast.ImportFrom):
                base = _relative(self.module, n.level, n.module, self.package)
                if base:
                    self.edge(self.module, "imports", base, True)
                for a in n.names:
                    if a.name != "*":
                        self.alias[a.asname or a.name] = f"{base}.{a.name}" if base else a.name
            elif isinstance(n, ast.Call) and dotted(n.func) in ("importlib.import_module", "import_module", "__import__") and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
                self.edge(self.module, "imports", n.args[0].value, True)

    def called(self, f: ast.expr, owner: str | None) -> tuple[str, bool] | None:
        if isinstance(f, ast.Name):
            return None if f.id in _BUILTIN and f.id not in self.alias else (self.alias.get(f.id, f.id), True)
        name = dotted(f)
        if not name:
            return None
        first, _, rest = name.partition(".")
        if first in ("self", "cls") and owner and "." not in rest:
            return f"{owner}.{rest}", False
        return (f"{self.alias[first]}.{rest}" if first in self.alias else name), True

    def calls(self, name: str, tree: ast.AST, owner: str | None) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.Call) and (hit := self.called(n.func, owner)):
                self.edge(name, "calls", *hit)

    def body(self, stmts: list[ast.stmt], parent: str, owner: str | None) -> None:
        for s in stmts:
            if isinstance(s, ast.ClassDef):
                name = f"{parent}.{s.name}"
                self.node(name, "class", s, ast.get_docstring(s))
                self.edge(parent, "contains", name)
                for b in s.bases:
                    if base := dotted(b):
                        first, _, rest = base.partition(".")
                        self.edge(name, "inherits", ".".join(filter(None, [self.alias.get(first, first), rest])), True)
                self.decorators(s, name)
                self.body(s.body, name, name)
            elif isinstance(s, _DEFS):
                name = f"{parent}.{s.name}"
                self.node(name, "method" if owner else "function", s, ast.get_docstring(s), measure(s))
                self.edge(parent, "contains", name)
                self.decorators(s, name)
                self.calls(name, s, owner)
            elif isinstance(s, ast.Assign | ast.AnnAssign):
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        self.node(f"{parent}.{t.id}", "constant", s)
                        self.edge(parent, "contains", f"{parent}.{t.id}")

    def decorators(self, s: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef, name: str) -> None:
        for d in s.decorator_list:
            if who := dotted(d.func if isinstance(d, ast.Call) else d):
                self.edge(who, "decorates", name, True)


def extract(source: bytes, path: str, module: str) -> Extract:
    """Nodes and edges of a file; a file that can't be parsed is its module alone."""
    w = _Walk(source, path, module)
    lines = source.count(b"\n") + 1
    w.out.nodes.append({"name": module, "type": "package" if w.package else "module", "file": path, "line": 1, "end_line": lines, "content_hash": digest(source)})
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return w.out
    w.out.nodes[0] |= {"docstring": ast.get_docstring(tree), "structure_hash": shape(tree)}
    w.imports(tree)
    w.body(tree.body, module, None)
    return w.out
