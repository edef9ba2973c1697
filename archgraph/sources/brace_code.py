"""JavaScript, TypeScript, C, C++ and Zig source to graph rows.

No parser for these is at hand, so a tokenizer removes comments and strings, braces give the
structure, and patterns recognise declarations at module, namespace and class level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from archgraph.sources.python_code import Extract, digest

_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\\\\[^\n]*|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$@][\w$]*|\d[\w.]*|&&|\|\||\?\?|=>|::|->|\.\.\.|[{}()\[\];,.<>=:?*&!~#+\-/%|^@\n]", re.S
)
_WORD = re.compile(r"[A-Za-z_$@]")
_JS_KEYWORDS = frozenset("if for while switch catch return function typeof new await yield do else try finally throw super import require delete void in of case default".split())
_C_KEYWORDS = frozenset("if for while switch return sizeof else do case default catch new delete throw alignof decltype static_assert defined typeid".split())
_ZIG_KEYWORDS = frozenset("if for while switch return else fn and or try catch orelse struct enum union const var pub comptime defer errdefer".split())


class Token:
    __slots__ = ("line", "start", "text")

    def __init__(self, text: str, line: int, start: int):
        self.text, self.line, self.start = text, line, start


def tokens(source: str, zig: bool = False) -> tuple[list[Token], dict[int, str]]:
    """Tokens without comments, and the comment that ends on a line before each line."""
    out, doc, line, last = [], {}, 1, 0
    for m in _TOKEN.finditer(source):
        text = m[0]
        line += source.count("\n", last, m.start())
        last = m.start()
        if text.startswith(("//", "/*")):
            end = line + text.count("\n")
            body = "\n".join(x.strip().lstrip("/*!").strip() for x in text.rstrip("*/").split("\n")).strip()
            doc[end + 1] = (doc.pop(line) + "\n" + body) if text.startswith("//") and line in doc else body
        elif text == "\n" or (text.startswith("\\\\") and zig):
            continue
        else:
            out.append(Token(text, line, m.start()))
    return out, doc


def closing(ts: list[Token], i: int) -> int:
    """The index of the bracket that closes the one at i."""
    pair = {"{": "}", "(": ")", "[": "]"}[ts[i].text]
    depth, opening = 0, ts[i].text
    for k in range(i, len(ts)):
        depth += (ts[k].text == opening) - (ts[k].text == pair)
        if not depth:
            return k
    return len(ts) - 1


def metrics(ts: list[Token], a: int, b: int, parameters: int, language: str) -> dict[str, int]:
    """Complexity by keywords and logical operators between two tokens."""
    branch = {"js": {"if", "else", "for", "while", "do", "case", "catch"}, "c": {"if", "else", "for", "while", "do", "switch", "case"}, "zig": {"if", "else", "for", "while", "switch", "catch", "try"}}[language]
    nest = {"if", "for", "while", "do", "switch", "try"}
    logic = {"and", "or"} if language == "zig" else {"&&", "||", "??"}
    cc, cognitive, deepest, returns, depth = 1, 0, 0, 0, 0
    opened: list[bool] = []
    pending = False
    for k in range(a, b + 1):
        t = ts[k].text
        if t in branch:
            cc += 1
            cognitive += 1 + depth
        elif t in logic or (t == "?" and language != "zig" and ts[min(k + 1, b)].text not in (".", ":", ",", ")")):
            cc += 1
            cognitive += 1
        if t in nest:
            pending = True
        elif t == "return":
            returns += 1
        elif t == "{":
            opened.append(pending)
            depth += pending
            deepest = max(deepest, depth)
            pending = False
        elif t == "}" and opened:
            depth -= opened.pop()
        elif t == ";":
            pending = False
    return {"cyclomatic_complexity": cc, "cognitive_complexity": cognitive, "max_nesting_depth": deepest, "lines_of_code": ts[b].line - ts[a].line + 1, "parameter_count": parameters, "return_count": returns}


class _Walk:
    def __init__(self, source: bytes, path: str, module: str, language: str):
        self.text = source.decode("utf-8", "replace")
        self.ts, self.doc = tokens(self.text, language == "zig")
        self.out, self.path, self.module, self.language = Extract(), path, module, language
        self.keywords = {"js": _JS_KEYWORDS, "c": _C_KEYWORDS, "zig": _ZIG_KEYWORDS}[language]
        self.out.nodes.append({"name": module, "type": "module", "file": path, "line": 1, "end_line": self.text.count("\n") + 1, "content_hash": digest(source)})
        self.alias: dict[str, str] = {}

    def at(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < len(self.ts) else ""

    def node(self, name: str, kind: str, a: int, b: int, m: dict | None = None) -> None:
        first, last = self.ts[a], self.ts[min(b, len(self.ts) - 1)]
        body = self.text[first.start : last.start + len(last.text)]
        shape = " ".join("_" if _WORD.match(t.text) and t.text not in self.keywords or t.text[0] in "\"'`0123456789" else t.text for t in self.ts[a : b + 1])
        self.out.nodes.append({"name": name, "type": kind, "file": self.path, "line": first.line, "end_line": last.line, "docstring": self.doc.get(first.line), "content_hash": digest(body.encode()), "structure_hash": digest(shape.encode()), "metrics": m, "cc": m and m["cyclomatic_complexity"]})

    def edge(self, source: str, rel: str, target: str, unresolved: bool = False) -> None:
        if (e := (source, rel, target, unresolved)) not in self.out.edges:
            self.out.edges.append(e)

    def add(self, parent: str, name: str, kind: str, a: int, b: int, m: dict | None = None) -> str:
        full = f"{parent}.{name}"
        self.node(full, kind, a, b, m)
        self.edge(parent, "contains", full)
        return full

    def parameters(self, i: int) -> int:
        j, depth, n = closing(self.ts, i), 0, 0
        for k in range(i + 1, j):
            depth += (self.at(k) in "([{<") - (self.at(k) in ")]}>")
            n += self.at(k) == "," and not depth
        return n + (j > i + 1 and not (j == i + 2 and self.at(i + 1) == "void"))

    def calls(self, name: str, owner: str | None, a: int, b: int) -> None:
        for k in range(a, b):
            if self.at(k + 1) != "(" or not _WORD.match(self.at(k)) or self.at(k) in self.keywords or self.at(k).startswith("@"):
                continue
            parts, i = [self.at(k)], k
            while self.at(i - 1) in (".", "::", "->") and _WORD.match(self.at(i - 2) or "0"):
                parts.insert(0, self.at(i - 2))
                i -= 2
            if self.at(i - 1) == "fn" or self.at(i - 1) == "function":
                continue
            if parts[0] in ("this", "self") and owner:
                if len(parts) == 2:
                    self.edge(name, "calls", f"{owner}.{parts[1]}")
                continue
            parts[0] = self.alias.get(parts[0], parts[0])
            self.edge(name, "calls", ".".join(parts), True)

    def function(self, parent: str, name: str, kind: str, a: int, paren: int, body: int, owner: str | None) -> int:
        end = closing(self.ts, body)
        full = self.add(parent, name, kind, a, end, metrics(self.ts, body, end, self.parameters(paren), self.language))
        self.calls(full, owner, body, end)
        return end


_ENDINGS = re.compile(r"\.(?:jsx?|mjs|cjs|tsx?)$")


def _js_module(here: str, target: str, package: bool) -> str:
    target = _ENDINGS.sub("", target)
    if not target.startswith("."):
        return target.lstrip("@").replace("/", ".")
    base = here.split(".")
    base = base if package else base[:-1]
    for part in target.split("/"):
        if part == "..":
            base = base[:-1]
        elif part not in (".", "index", ""):
            base = [*base, part]
    return ".".join(base)


def javascript(source: bytes, path: str, module: str) -> Extract:
    w = _Walk(source, path, module, "js")
    package = re.search(r"(?:^|/)index\.\w+$", path) is not None
    for m in re.finditer(r"""import\s+(?:type\s+)?([^;'"]*?)\s*from\s*['"]([^'"]+)['"]|import\s*['"]([^'"]+)['"]|(?:const|let|var)\s+([\w$]+|\{[^}]*\})\s*=\s*require\(\s*['"]([^'"]+)['"]|export\s+[^;'"]*?from\s*['"]([^'"]+)['"]|\bimport\(\s*['"]([^'"]+)['"]""", w.text):
        target = _js_module(module, next(x for x in (m[2], m[3], m[5], m[6], m[7]) if x), package)
        w.edge(module, "imports", target, True)
        names = m[1] or m[4] or ""
        for n in re.findall(r"\*\s*as\s+([\w$]+)", names):
            w.alias[n] = target
        for group in re.findall(r"\{([^}]*)\}", names):
            for item in group.split(","):
                pair = re.split(r"\s+as\s+|\s*:\s*", item.strip())
                if pair[0]:
                    w.alias[pair[-1]] = f"{target}.{pair[0]}"
        if (n := re.match(r"[\w$]+", names)) and n[0] != "type":
            w.alias[n[0]] = target

    def walk(i: int, end: int, parent: str, owner: str | None) -> None:
        start = i
        while i < end:
            t = w.at(i)
            if t in ("class", "interface") and _WORD.match(w.at(i + 1) or "0"):
                body = next((k for k in range(i, end) if w.at(k) == "{"), end)
                close = closing(w.ts, body) if body < end else end
                name = w.add(parent, w.at(i + 1), "class" if t == "class" else "interface", i, close)
                rel = ""
                for k in range(i + 2, body):
                    if w.at(k) in ("extends", "implements"):
                        rel = "inherits" if w.at(k) == "extends" else "implements"
                    elif rel and _WORD.match(w.at(k)) and w.at(k - 1) in ("extends", "implements", ","):
                        w.edge(name, rel, w.alias.get(w.at(k), w.at(k)), True)
                if t == "class":
                    walk(body + 1, close, name, name)
                i = close
            elif t == "function" and not owner:
                k = i + 1 + (w.at(i + 1) == "*")
                name = w.at(k) if w.at(k) != "(" else "default"
                paren = k if name == "default" else k + 1
                if w.at(paren) == "<":
                    paren = next((j for j in range(paren, end) if w.at(j) == "("), paren)
                body = next((j for j in range(closing(w.ts, paren), end) if w.at(j) in ("{", ";")), end) if w.at(paren) == "(" else end
                if w.at(body) == "{":
                    i = w.function(parent, name, "function", i, paren, body, None)
            elif t in ("const", "let", "var") and not owner and _WORD.match(w.at(i + 1) or "0"):
                name, eq = w.at(i + 1), next((k for k in range(i + 2, min(end, i + 60)) if w.at(k) in ("=", ";")), end)
                k = eq + 1 + (w.at(eq + 1) == "async")
                arrow = closing(w.ts, k) + 1 if w.at(k) == "(" else k + 1
                if w.at(k) == "(" and w.at(arrow) == ":":
                    arrow = next((j for j in range(arrow, min(end, arrow + 40)) if w.at(j) == "=>"), arrow)
                if w.at(k) == "function":
                    paren = next((j for j in range(k, end) if w.at(j) == "("), end)
                    body = closing(w.ts, paren) + 1
                    if w.at(body) == "{":
                        i = w.function(parent, name, "function", i, paren, body, None)
                elif w.at(eq) == "=" and w.at(arrow) == "=>":
                    if w.at(arrow + 1) == "{":
                        i = w.function(parent, name, "function", i, k if w.at(k) == "(" else arrow, arrow + 1, None) if w.at(k) == "(" else _arrow(w, parent, name, i, arrow + 1)
                    else:
                        stop = next((j for j in range(arrow, end) if w.at(j) == ";" or w.ts[j].line > w.ts[arrow].line), end - 1)
                        full = w.add(parent, name, "function", i, stop, metrics(w.ts, arrow, stop, w.parameters(k) if w.at(k) == "(" else 1, "js"))
                        w.calls(full, None, arrow, stop)
                        i = stop
                elif name.isupper():
                    stop = next((j for j in range(eq, end) if w.at(j) == ";" or w.ts[j].line > w.ts[eq].line), end - 1)
                    w.add(parent, name, "constant", i, stop)
            elif owner and _WORD.match(t) and w.at(i + 1) == "(" and t not in w.keywords:
                close = closing(w.ts, i + 1)
                body = next((j for j in range(close, min(end, close + 40)) if w.at(j) in ("{", ";", "=")), end)
                i = w.function(parent, t, "method", i, i + 1, body, owner) if w.at(body) == "{" else close
            elif t == "{" and i > start:
                i = closing(w.ts, i)
            i += 1

    walk(0, len(w.ts), module, None)
    return w.out


def _arrow(w: _Walk, parent: str, name: str, a: int, body: int) -> int:
    end = closing(w.ts, body)
    full = w.add(parent, name, "function", a, end, metrics(w.ts, body, end, 1, "js"))
    w.calls(full, None, body, end)
    return end


def c_family(source: bytes, path: str, module: str) -> Extract:
    w = _Walk(source, path, module, "c")
    for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"]+)[>\"]", w.text, re.M):
        w.edge(module, "imports", re.sub(r"\.(?:hpp|hh|hxx|h|cuh)$", "", m[1]).replace("../", "").replace("/", "."), True)
    for m in re.finditer(r"^[ \t]*#[ \t]*define[ \t]+(\w+)(\(?)", w.text, re.M):
        line = w.text.count("\n", 0, m.start()) + 1
        name = f"{module}.{m[1]}"
        w.out.nodes.append({"name": name, "type": "function" if m[2] else "constant", "file": path, "line": line, "end_line": line, "metadata": '{"macro":true}'})
        w.edge(module, "contains", name)
    directive = {w.text.count("\n", 0, m.start()) + 1 + k for m in re.finditer(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", w.text, re.M) for k in range(m[0].count("\n") + 1)}
    w.ts = [t for t in w.ts if t.line not in directive]

    def walk(i: int, end: int, parent: str, owner: str | None) -> None:
        head = i
        while i < end:
            t = w.at(i)
            if t == "namespace" and w.at(i + 1) != "=":
                body = next((k for k in range(i, end) if w.at(k) == "{"), end)
                name = ".".join(w.at(k) for k in range(i + 1, body) if _WORD.match(w.at(k)))
                close = closing(w.ts, body) if body < end else end
                walk(body + 1, close, w.add(parent, name, "package", i, close) if name else parent, None)
                i = close
                head = i + 1
            elif t in ("class", "struct", "union", "enum") and _WORD.match(w.at(i + 1) or "0"):
                k = i + 1 + (w.at(i + 1) in ("class", "struct"))
                body = next((j for j in range(k, end) if w.at(j) in ("{", ";", "(", "=", ")", ",", "*", "&")), end)
                if w.at(body) == "{":
                    close = closing(w.ts, body)
                    name = w.add(parent, w.at(k), "type" if t == "enum" else "class", i, close)
                    for j in range(k + 1, body):
                        if t != "enum" and w.at(j - 1) in (":", ",", "public", "private", "protected", "virtual") and _WORD.match(w.at(j)) and w.at(j) not in ("public", "private", "protected", "virtual"):
                            w.edge(name, "inherits", w.at(j), True)
                    if t != "enum":
                        walk(body + 1, close, name, name)
                    i = close
            elif t == "typedef":
                stop = next((j for j in range(i, end) if w.at(j) == ";"), end - 1)
                j = i
                while j < stop:
                    if w.at(j) == "{":
                        j = closing(w.ts, j)
                        stop = next((x for x in range(j, end) if w.at(x) == ";"), end - 1)
                    j += 1
                if _WORD.match(w.at(stop - 1) or "0"):
                    w.add(parent, w.at(stop - 1), "type", i, stop)
                i, head = stop, stop + 1
            elif t == "(" and i > head and _WORD.match(w.at(i - 1)) and w.at(i - 1) not in w.keywords and "=" not in [w.at(j) for j in range(head, i)]:
                close = closing(w.ts, i)
                body = next((j for j in range(close + 1, end) if w.at(j) in ("{", ";", "=", "(", ",")), end)
                if w.at(body) == ":" or (w.at(close + 1) == ":" and owner):
                    body = next((j for j in range(close + 1, end) if w.at(j) in ("{", ";")), end)
                name, scope = w.at(i - 1), owner
                if w.at(i - 2) == "~":
                    name = "~" + name
                k = i - 2
                outer = []
                while w.at(k) == "::" and _WORD.match(w.at(k - 1) or "0"):
                    outer.insert(0, w.at(k - 1))
                    k -= 2
                where = f"{parent}.{'.'.join(outer)}" if outer else parent
                kind = "method" if owner or outer else "function"
                if w.at(body) == "{":
                    i = w.function(where, name, kind, head, i, body, where if kind == "method" else scope)
                elif owner and w.at(body) in (";", "=") and k >= head:
                    w.add(where, name, kind, head, close, metrics(w.ts, i, close, w.parameters(i), "c"))
                    i = body
                else:
                    i = close
                head = i + 1
            elif t == "{":
                i = closing(w.ts, i)
            if w.at(i) in (";", "}") or (w.at(i) == ":" and w.at(i - 1) in ("public", "private", "protected")):
                head = i + 1
            i += 1

    walk(0, len(w.ts), module, None)
    seen: set[str] = set()
    w.out.nodes = [n for n in w.out.nodes if not (n["name"] in seen or seen.add(n["name"]))]
    return w.out


def zig(source: bytes, path: str, module: str) -> Extract:
    w = _Walk(source, path, module, "zig")
    for m in re.finditer(r'(?:const\s+(\w+)\s*=\s*)?@import\("([^"]+)"\)', w.text):
        target = re.sub(r"\.zig$", "", m[2]).replace("../", "").replace("/", ".")
        if m[2].endswith(".zig"):
            target = ".".join([*module.split(".")[:-1], target])
        w.edge(module, "imports", target, True)
        if m[1]:
            w.alias[m[1]] = target

    def walk(i: int, end: int, parent: str, owner: str | None) -> None:
        while i < end:
            t = w.at(i)
            if t in ("const", "var") and w.at(i + 2) in ("=", ":"):
                name, eq = w.at(i + 1), next((k for k in range(i, end) if w.at(k) in ("=", ";")), end)
                kind = next((w.at(k) for k in range(eq + 1, min(eq + 4, end)) if w.at(k) in ("struct", "enum", "union")), "")
                stop = next((k for k in _outside(w, eq, end) if w.at(k) == ";"), end - 1)
                if kind:
                    body = next((k for k in range(eq, end) if w.at(k) == "{"), end)
                    full = w.add(parent, name, "type" if kind == "enum" else "class", i, stop)
                    walk(body + 1, closing(w.ts, body), full, full)
                elif t == "const" and "@import" not in [w.at(k) for k in range(eq, stop)]:
                    w.add(parent, name, "constant", i, stop)
                i = stop
            elif t == "fn" and _WORD.match(w.at(i + 1) or "0"):
                close = closing(w.ts, i + 2)
                body = next((k for k in range(close, end) if w.at(k) in ("{", ";")), end)
                method = owner is not None and w.at(i + 3) == "self"
                i = w.function(parent, w.at(i + 1), "method" if method else "function", i, i + 2, body, owner) if w.at(body) == "{" else body
            elif t == "test" and w.at(i + 1)[:1] == '"' and w.at(i + 2) == "{":
                name = "test_" + re.sub(r"\W+", "_", w.at(i + 1).strip('"')).strip("_")
                close = closing(w.ts, i + 2)
                full = w.add(parent, name, "function", i, close, metrics(w.ts, i + 2, close, 0, "zig"))
                w.calls(full, None, i + 2, close)
                i = close
            elif t == "{":
                i = closing(w.ts, i)
            i += 1

    walk(0, len(w.ts), module, None)
    return w.out


def _outside(w: _Walk, i: int, end: int) -> Iterator[int]:
    """Indices from i on, bracketed stretches skipped."""
    while i < end:
        yield i
        i = closing(w.ts, i) + 1 if w.at(i) in ("{", "(", "[") else i + 1
