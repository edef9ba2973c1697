"""Source code to graph: small programs in each language, scans of trees, and watching."""

from __future__ import annotations

import time

import pytest

from archgraph.sources import brace_code, code, python_code, stored
from archgraph.streaming import watch


def nodes(found):
    return {n["name"]: n for n in found.nodes}


PYTHON = '''"""Doc of the module."""
import os
from . import helpers as h
from .base import Base

LIMIT = 3

@h.wrap
class Engine(Base):
    """Runs."""
    SIZE = 1

    def run(self, a, b=1, *c):
        if a and b or c:
            for x in c:
                return x
        self.stop()
        with open(a):
            pass
        return h.go(LIMIT)

    def stop(self):
        def inner():
            if 1: pass
        return None

def main():
    Engine().run(1)
'''


def test_python():
    found = python_code.extract(PYTHON.encode(), "src/app/core.py", "app.core")
    n = nodes(found)
    assert {k: v["type"] for k, v in n.items()} == {"app.core": "module", "app.core.LIMIT": "constant", "app.core.Engine": "class", "app.core.Engine.SIZE": "constant", "app.core.Engine.run": "method", "app.core.Engine.stop": "method", "app.core.main": "function"}
    m = n["app.core.Engine.run"]["metrics"]
    assert (m["cyclomatic_complexity"], m["max_nesting_depth"], m["return_count"], m["parameter_count"]) == (6, 2, 2, 4)
    assert n["app.core.Engine.stop"]["cc"] == 1 and n["app.core.Engine"]["docstring"] == "Runs."
    e = {x[:3] for x in found.edges}
    assert {("app.core", "imports", "os"), ("app.core", "imports", "app"), ("app.core", "imports", "app.base"), ("app.core.Engine", "inherits", "app.base.Base"), ("app.core.Engine.run", "calls", "app.core.Engine.stop"), ("app.core.Engine.run", "calls", "app.helpers.go"), ("h.wrap", "decorates", "app.core.Engine"), ("app.core.main", "calls", "Engine")} <= e
    assert not any(t == "open" for _, _, t in e)


def test_hashes_and_deep_code():
    a, b = (nodes(python_code.extract(s, "a.py", "a")) for s in (b"def f(x):\n    return x + 1\n", b"def f(y):  # note\n    return y + 2\n"))
    assert a["a.f"]["structure_hash"] == b["a.f"]["structure_hash"] and a["a.f"]["content_hash"] != b["a.f"]["content_hash"]
    assert python_code.digest(b"abc") == "44bc2cf5ad770999"
    deep = "def f():\n" + "".join(" " * (i + 1) + "if 1:\n" for i in range(90)) + " " * 91 + "pass\n"
    m = nodes(python_code.extract(deep.encode(), "d.py", "d"))["d.f"]["metrics"]
    assert (m["cyclomatic_complexity"], m["max_nesting_depth"]) == (91, 90)
    assert list(nodes(python_code.extract(b"def (", "x.py", "x"))) == ["x"]


def test_javascript():
    src = b"""import { go as run } from './lib/tools';
import * as ns from "@scope/pkg";
/** Opens. */
export class Shop extends Base implements Api, Other {
  open(a, b) { if (a && b) { return this.close(); } run(a); }
  async close() { return ns.end() }
}
interface Api { open(): void }
const LIMIT = 5;
export const add = (x, y) => x + helper(y);
const big = async (x) => { for (const i of x) { helper(i) } };
function helper(z) { return z ? 1 : 2; }
"""
    found = brace_code.javascript(src, "src/shop.ts", "shop")
    assert {k: v["type"] for k, v in nodes(found).items()} == {"shop": "module", "shop.Shop": "class", "shop.Shop.open": "method", "shop.Shop.close": "method", "shop.Api": "interface", "shop.LIMIT": "constant", "shop.add": "function", "shop.big": "function", "shop.helper": "function"}
    e = {x[:3] for x in found.edges}
    assert {("shop", "imports", "lib.tools"), ("shop", "imports", "scope.pkg"), ("shop.Shop", "inherits", "Base"), ("shop.Shop", "implements", "Api"), ("shop.Shop", "implements", "Other"), ("shop.Shop.open", "calls", "shop.Shop.close"), ("shop.Shop.open", "calls", "lib.tools.go"), ("shop.add", "calls", "helper"), ("shop.big", "calls", "helper")} <= e
    assert nodes(found)["shop.Shop.open"]["cc"] == 3 and nodes(found)["shop.Shop"]["docstring"] == "Opens."


def test_c_and_cpp():
    src = b"""#include "util/tools.h"
#define LIMIT 3
#define TWICE(x) ((x) * 2)
typedef struct { int a; } Pair;
enum Color { RED, BLUE };
namespace shop {
class Store : public Base {
 public:
  int open(int a) { if (a && LIMIT) { return helper(a); } return 0; }
  void close();
};
void Store::close() { helper(1); }
}
static int helper(int x) { for (int i = 0; i < x; i++) { if (i) x++; } return x; }
int main(void) { return helper(2); }
"""
    found = brace_code.c_family(src, "src/main.cpp", "main")
    kinds = {k: v["type"] for k, v in nodes(found).items()}
    expected = {"main.LIMIT": "constant", "main.TWICE": "function", "main.Pair": "type", "main.Color": "type", "main.shop": "package", "main.shop.Store": "class", "main.shop.Store.open": "method", "main.shop.Store.close": "method", "main.helper": "function", "main.main": "function"}
    assert expected.items() <= kinds.items()
    e = {x[:3] for x in found.edges}
    assert {("main", "imports", "util.tools"), ("main.shop.Store", "inherits", "Base"), ("main.shop.Store.open", "calls", "helper"), ("main.main", "calls", "helper")} <= e
    assert nodes(found)["main.helper"]["cc"] == 3


def test_zig():
    src = b"""const std = @import("std");
const tools = @import("tools.zig");
/// A list.
pub const List = struct {
    size: usize,
    pub fn grow(self: *List, n: usize) void { if (n > 1 and self.size > 2) { tools.go(n); } self.reset(); }
    fn reset(self: *List) void {}
};
pub const Kind = enum { a, b };
const MAX = 10;
pub fn main() !void { helper(); }
fn helper() void {}
test "it works" { helper(); }
"""
    found = brace_code.zig(src, "src/app.zig", "app")
    assert {"app.List": "class", "app.Kind": "type", "app.MAX": "constant", "app.List.grow": "method", "app.List.reset": "method", "app.main": "function", "app.helper": "function", "app.test_it_works": "function"}.items() <= {k: v["type"] for k, v in nodes(found).items()}.items()
    e = {x[:3] for x in found.edges}
    assert {("app", "imports", "tools"), ("app.List.grow", "calls", "tools.go"), ("app.List.grow", "calls", "app.List.reset"), ("app.test_it_works", "calls", "helper")} <= e


@pytest.mark.parametrize(("path", "name"), [("src/app/core.py", "app.core"), ("src/app/__init__.py", "app"), ("app.py", "app"), ("lib/index.ts", "lib"), ("packages/x/src/a.ts", "org.x.a")])
def test_module_names(path, name):
    assert code.module_name(path, {"packages/x": "@org/x"}) == name


FILES = {
    "src/lib/__init__.py": "",
    "src/lib/core.py": "from .utils import double\nclass Base:\n    def go(self):\n        return double(2)\nclass Child(Base):\n    def start(self):\n        self.go()\n",
    "src/lib/utils.py": "def double(x):\n    return unknown(x)\n\ndef caller():\n    return double(1)\n",
    "node_modules/x.js": "function no() {}",
    ".hidden/y.py": "def no(): pass",
    "notes.txt": "no",
}


def _write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_scan(spark, tmp_path):
    _write(tmp_path, FILES)
    sources = code.files(spark, str(tmp_path))
    assert sorted(r["path"] for r in sources.collect()) == ["src/lib/__init__.py", "src/lib/core.py", "src/lib/utils.py"]
    assert code.files(spark, str(tmp_path), excludes=("core*",)).count() == 2
    g, skipped = code.scan(sources)
    e = {(r["source"], r["rel"], r["target"]) for r in g.edges.collect()}
    assert {("lib", "contains", "lib.core"), ("lib.core", "imports", "lib.utils"), ("lib.core.Child", "inherits", "lib.core.Base"), ("lib.core.Base.go", "calls", "lib.utils.double"), ("lib.core.Child.start", "calls", "lib.core.Base.go"), ("lib.utils.caller", "calls", "lib.utils.double")} <= e
    assert g.validate().count() == 0
    assert [(r["target"], r["category"]) for r in skipped.collect()] == [("unknown", "unresolved_local")]
    # A later scan of one file keeps what was made by hand and drops what went.
    g = g.upsert(spark.createDataFrame([("note", "config", "manual")], "name string, type string, provenance string")).link(spark.createDataFrame([("note", "tests", "lib.core.Base")], "source string, rel string, target string"))
    changed = spark.createDataFrame([("src/lib/utils.py", bytearray(b"def double(x):\n    return x\n"))], "path string, content binary")
    g2, _ = code.scan(changed, into=g)
    names = {r["name"] for r in g2.nodes.collect()}
    assert "lib.utils.caller" not in names and {"note", "lib.core.Child", "lib.utils.double"} <= names
    e = {(r["source"], r["rel"], r["target"]) for r in g2.edges.collect()}
    assert ("note", "tests", "lib.core.Base") in e and ("lib.core.Base.go", "calls", "lib.utils.double") in e and g2.validate().count() == 0


def test_watch(spark, tmp_path):
    _write(tmp_path / "tree", {"a.py": "def f():\n    pass\n"})
    seen = []
    q = watch.watch(spark, str(tmp_path / "tree"), str(tmp_path / "store"), str(tmp_path / "ck"), lambda d, n: seen.append({(r["name"], r["change"]) for r in d.collect()}), every="0 seconds")
    try:
        q.processAllAvailable()
        time.sleep(0.1)
        _write(tmp_path / "tree", {"b.py": "from a import f\ndef g():\n    f()\n"})
        q.processAllAvailable()
    finally:
        q.stop()
    assert ("a.f", "added") in seen[0] and ("b.g", "added") in seen[1] and ("a.f", "added") not in seen[1]
    g = stored.read_parquet(spark, str(tmp_path / "store" / "1"))
    assert ("b.g", "calls", "a.f") in {(r["source"], r["rel"], r["target"]) for r in g.edges.collect()}


def test_windowed_churn(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a"), ("2024-01-01 11:10:00", "b")]
    spark.createDataFrame(rows, "t string, file string").selectExpr("cast(t as timestamp) ts", "file").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, file string").parquet(str(tmp_path / "in"))
    q = watch.churn_by_window(stream).writeStream.format("memory").queryName("churn_w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["file"], r["hunks"]) for r in spark.table("churn_w").collect()) == [("a", 2), ("b", 1)]
