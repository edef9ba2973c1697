"""What a review found missing or lost: state of a watched tree, deletions, git, the command line, search syntax, rules."""

from __future__ import annotations

import itertools
import json
import random
import subprocess
import time
from collections import deque

import pytest

from archgraph import __main__ as cli
from archgraph.functions import scalars
from archgraph.model import COUPLING, Graph
from archgraph.operators import analytics, concepts, context, history, oo, report, rules, search, traverse
from archgraph.plans.queries import queries
from archgraph.adapters import tables
from archgraph.sources import code, git, stored
from archgraph.streaming import watch
from tests.conftest import SMALL
from tests.test_graph import build, calls, pairs


def _write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


# Watching and scanning


def test_watch_keeps_the_graph_over_other_files_and_deletions(spark, tmp_path):
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    _write(tree, {"a.py": "def f():\n    pass\n", "sub/old.py": "def o():\n    pass\n"})
    q = watch.watch(spark, str(tree), store, str(tmp_path / "ck"), every="0 seconds")
    try:
        q.processAllAvailable()
        time.sleep(0.1)
        _write(tree, {"notes.md": "not code\n"})
        q.processAllAvailable()
        time.sleep(0.1)
        _write(tree, {"b.py": "from a import f\ndef g():\n    f()\n"})
        q.processAllAvailable()
        names = {r["name"] for r in watch.latest(spark, store).nodes.collect()}
        assert {"a", "a.f", "b", "b.g", "sub", "sub.old.o"} <= names
        (tree / "sub" / "old.py").unlink()
        time.sleep(0.1)
        _write(tree, {"c.py": "def h():\n    pass\n"})
        q.processAllAvailable()
    finally:
        q.stop()
    assert q.exception() is None
    names = {r["name"] for r in watch.latest(spark, store).nodes.collect()}
    assert {"a.f", "b.g", "c.h"} <= names and not {n for n in names if n.startswith("sub")}
    assert len(watch.versions(spark, store)) == 2


def test_ignore_file_inherited_calls_and_orphans(spark, tmp_path):
    _write(tmp_path, {
        code.IGNORE_FILE: "# not these\n\nskipped*\ngen/\n", "skipped_one.py": "x = 1\n", "gen/g.py": "x = 1\n",
        "m.py": "class A:\n    def go(self):\n        pass\nclass B(A):\n    pass\nclass C(B):\n    def run(self):\n        self.go()\n", "pkg/n.py": "import m\ndef lone():\n    x.get()\n    Thing()\n",
    })
    sources = code.files(spark, str(tmp_path))
    assert sorted(r["path"] for r in sources.collect()) == ["m.py", "pkg/n.py"]
    g, skipped = code.scan(sources)
    assert ("m.C.run", "calls", "m.A.go") in {(r["source"], r["rel"], r["target"]) for r in g.edges.collect()}
    told = {r["category"]: (r["count"], r["hint"], list(r["samples"])) for r in code.diagnosis(skipped).collect()}
    assert told["attribute_call"][0] == 1 and "Thing" in told["external_call"][2][0] and all(h for _, h, _ in told.values())
    linked = g.link(spark.createDataFrame([("pkg.n.lone", "tests", "m.A")], "source string, rel string, target string"))
    after, _ = code.scan(sources.where("false"), into=linked, gone=spark.createDataFrame([("pkg/n.py",)], "path string"))
    names = {r["name"] for r in after.nodes.collect()}
    assert "m.A" in names and not {n for n in names if n.startswith("pkg")} and after.validate().count() == 0
    assert [tuple(r) for r in code.orphans(linked, after).collect()] == [("pkg.n.lone", "tests", "m.A", "source node removed")]
    fans = {r["name"]: json.loads(r["metadata"] or "{}") for r in code.stamp_fans(g).nodes.collect()}
    assert fans["m.C.run"]["fan_out"] == "1" and fans["m.A.go"]["fan_in"] == "1"


def test_git_and_the_command_line(spark, tmp_path, capsys, monkeypatch):
    root = tmp_path / "repo"
    _write(root, {"a.py": "def f():\n    pass\n", "b.py": "from a import f\ndef g():\n    f()\n"})
    run = lambda *args: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@example.com", "-C", str(root), *args], check=True, capture_output=True)
    run("init", "-q")
    store = str(tmp_path / "store")
    monkeypatch.setattr(cli, "SparkSession", type("S", (), {"builder": type("B", (), {"appName": lambda s, n: s, "config": lambda s, *a: s, "getOrCreate": lambda s: spark})()}))
    call = lambda *args: cli.main(["--graph", store, "--json", *args])
    assert call("scan", str(root)) == 0
    g = stored.read_parquet(spark, f"{store}/graph")
    stored.write_jsonl(g, str(root / "stored"))
    (part,) = (root / "stored").glob("part-*")
    (root / "graph.jsonl").write_text(part.read_text())
    run("add", "a.py", "b.py", "graph.jsonl")
    run("commit", "-qm", "first")
    again = git.graph_at(spark, str(root), "graph.jsonl")
    assert pairs(again.nodes, "name") == pairs(g.nodes, "name") and pairs(again.edges, "source", "rel", "target") == pairs(g.edges, "source", "rel", "target")
    assert git.graph_at(spark, str(root), "none.jsonl") is None
    _write(root, {"a.py": "def f():\n    return 1\n", "c.py": "x = 1\n"})
    assert pairs(git.changed_files(spark, str(root)), "path") == [("a.py",), ("c.py",)]
    run("commit", "-qam", "second")
    assert {(r["name"], r["summary"]) for r in git.blame(g, str(root), "a.py").collect()} >= {("a.f", "second")}
    assert ("a.f", 2) in pairs(history.entity_churn(g, history.hunks_from_git(spark, str(root))), "name", "touches")
    capsys.readouterr()
    assert call("callers", "a.f") == 0 and '"b.g"' in capsys.readouterr().out
    for command in (["status"], ["overview"], ["list"], ["about", "a.f"], ["containment", "a.f"], ["impact", "a.f"], ["path", "b.g", "a.f"], ["subgraph", "a.f"], ["analyze", "pagerank"], ["search", "f"], ["export", "text"], ["export", "dot"], ["validate"], ["churn", str(root)], ["blame", str(root), "a.py"], ["rules"], ["concepts"]):
        assert call(*command) == 0, command
    assert call("rule-add", "no", "--deny", "b.* -> a.*") == 0 and call("check") == 1
    assert call("rule-add", "bad", "--forall", "*", "--assertion", "nonsense < 3") == 2
    assert call("rule-rm", "no") == 0 and call("check") == 0
    assert call("concept-add", "left", "--prefix", "a") == 0 and call("concept-report") == 0
    assert call("callers", "nothing") == 2


# Search, rules, scalars


def test_search_alternatives_and_phrases(spark, tmp_path):
    g = build(spark, calls("parse_file>x"), None, parse_file={"docstring": "Reads one file at a time."}, x={"docstring": "One time only, a file."}, lone={"docstring": "Nothing."})
    g = Graph(g.nodes.unionByName(build(spark, [], {"lone": "class"}, lone={"docstring": "Nothing here."}).nodes), g.edges)
    index = search.build_index(g)
    search.store_index(index, str(tmp_path / "index"))
    for found in (index, search.load_index(spark, str(tmp_path / "index"))):
        ask = lambda q, **o: {r["name"] for r in search.search(found, g, q, **o).collect()}  # noqa: E731, B023
        assert ask("reads OR nothing") == {"parse_file", "lone"}
        assert ask('"file at a time"') == {"parse_file"} and ask('"a file"') == {"x"} and ask('"time file"') == set()
        assert ask("file NOT reads") == {"x"} and ask("parseFile") == {"parse_file"}
    hits, total = search.results(index, g, "file", limit=1)
    assert total == 2 and hits.collect()[0]["rank"] == 1
    with pytest.raises(ValueError, match="OR"):
        search.search(index, g, "file OR ")


def test_rules_are_refused_before_any_runs(spark):
    g = build(spark, calls("ui.a>db.q"))
    for bad in (rules.Rule("r", "quantified", selector="*", assertion="nonsense < 1"), rules.Rule("r", "invariant", invariant="no-such"), rules.Rule("r", "odd"), rules.Rule("r", "deny", pattern="x")):
        with pytest.raises(rules.RuleError):
            rules.check_all(Graph(None, None), [rules.Rule("first", "deny", pattern="a -> b"), bad])  # the graph isn't touched
    (v,) = rules.violations(g, [rules.Rule("no", "deny", pattern="ui.* -> db.*"), rules.Rule("fine", "deny", pattern="db.* -> ui.*")]).collect()
    assert (v["rule"], v["type"], v["message"], list(v["edges"]), v["nodes"], v["cycles"]) == ("no", "deny", "no is violated by 1", ["ui.a -[calls]-> db.q"], None, None)


def test_key_values(spark):
    df = spark.createDataFrame([("a=1,b=x=y,c=one, two,d=",)], "t string")
    assert df.select(scalars.key_values(df.t).alias("m")).collect()[0]["m"] == {"a": "1", "b": "x=y", "c": "one, two", "d": ""}


# Random graphs against plain Python


def _random(rng, n, m, rel="calls"):
    return sorted({(f"n{rng.randrange(n)}", rel, f"n{rng.randrange(n)}") for _ in range(m)})


def _undirected(edges):
    out = {}
    for a, _, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def _distances(near, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w in near.get(v, ()):
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen


def test_shortest_paths_by_least_names(spark):
    rng = random.Random(2)
    edges = _random(rng, 40, 55)
    g, near = build(spark, edges), _undirected(edges)
    names = sorted(near)
    for source, target in [rng.sample(names, 2) for _ in range(4)]:
        far = _distances(near, source)
        expected = []
        if target in far:
            expected = [target]
            while expected[-1] != source:
                expected.append(min(w for w in near[expected[-1]] if far.get(w) == far[expected[-1]] - 1))
        assert [r["name"] for r in traverse.shortest_path(g, source, target).orderBy("step").collect()] == expected[::-1]


def _bridges(edges):
    near = _undirected(edges)
    out = set()
    for a, b in {tuple(sorted((a, b))) for a, _, b in edges if a != b}:
        near[a].discard(b)
        near[b].discard(a)
        if b not in _distances(near, a):
            out.add((a, b))
        near[a].add(b)
        near[b].add(a)
    return out


def test_bridges_beyond_the_kernel(spark, monkeypatch):
    edges = _random(random.Random(4), 25, 60) + calls("n1>t1", "t1>t2", "n2>u1")
    g = build(spark, edges)
    assert set(pairs(analytics.bridges(g), "a", "b")) == _bridges(edges)
    monkeypatch.setattr(analytics, "KERNEL_EDGES", 55)
    assert set(pairs(analytics.bridges(g), "a", "b")) == _bridges(edges)


def test_depth_of_inheritance_both_ways(spark):
    edges = _random(random.Random(6), 20, 22, "inherits")
    g = build(spark, edges, {f"n{i}": "class" for i in range(20)})
    assert pairs(oo.dit(g), "class", "dit") == pairs(oo.dit(g, distributed=True), "class", "dit")


def test_renames_with_a_root_that_all_share(spark):
    old = [f"app.core.mod{i}.item{i}" for i in range(30)]
    new = [f"app.core.mod{i}.new.item{i}" for i in range(20)] + [f"app.other{i}" for i in range(10)]
    a, b = build(spark, [], dict.fromkeys(old, "function")), build(spark, [], dict.fromkeys(new, "function"))
    assert pairs(history.renames(a, b), "old_name", "new_name", "kind") == sorted((f"app.core.mod{i}.item{i}", f"app.core.mod{i}.new.item{i}", "fuzzy") for i in range(20))
    changes = {(r["name"], r["change"]) for r in history.diff(a, b).collect()}
    assert changes == {(new[i], "renamed") for i in range(20)} | {(n, "added") for n in new[20:]} | {(n, "removed") for n in old[20:]}


def test_betweenness_of_any_size_if_asked_for(spark, monkeypatch):
    g = build(spark, calls("a>b", "b>c"))
    monkeypatch.setattr(analytics, "BETWEENNESS_NODES", 2)
    assert analytics.betweenness(g).count() == 0
    assert dict(pairs(analytics.betweenness(g, include=True), "name", "betweenness"))["b"] == 1.0


def test_run_analysis(spark):
    g = build(spark, [("m", "contains", "m.C"), ("m.C", "contains", "m.C.f"), ("m.C.f", "calls", "m.g"), ("m.g", "calls", "m.C.f"), ("m", "contains", "m.g")], {"m": "module", "m.C": "class", "m.C.f": "method", "m.g": "function"})
    steps = []
    found = report.run_analysis(g, declared=[concepts.Concept("all", ("m",))], on_step=steps.append)
    assert set(steps) | {"hotspots"} == set(found) and pairs(found["cycles"], "name") == [("m.C.f",), ("m.g",)]
    assert "hits" not in report.run_analysis(g, full=False)
    assert report.only(found, spark.createDataFrame([("m.g",)], "name string"))["layering_violations"].count() == 2


# Queries without SQL, on their own rows


@pytest.fixture(scope="module")
def small(spark):
    g = tables.graph(spark, SMALL)
    return [(r["source"], r["rel"], r["target"]) for r in g.edges.where(g.edges.rel.isin(*COUPLING)).collect()]


def test_bridges_query(spark, small):
    assert set(pairs(queries()["bridges"](spark, SMALL), "a", "b")) == _bridges(small)


def test_betweenness_query(spark, small):
    """By counting shortest paths through each node between all pairs."""
    inside = [(a, r, b) for a, r, b in small if a.startswith("cat") and b.startswith("cat")]
    near = _undirected(inside)
    names = sorted({x for a, _, b in inside for x in (a, b)})
    far = {v: _distances(near, v) for v in names}
    ways = {}
    for s in names:
        count = {s: 1}
        for v in sorted(far[s], key=far[s].get):
            if v != s:
                count[v] = sum(count[w] for w in near[v] if far[s].get(w, -1) == far[s][v] - 1)
        ways[s] = count
    expected = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        if t in far[s]:
            for v in names:
                if v not in (s, t) and v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t]:
                    expected[v] += ways[s][v] * ways[v][t] / ways[s][t]
    n = len(names)
    got = dict(pairs(queries()["betweenness"](spark, SMALL), "name", "betweenness"))
    assert set(got) == set(expected)
    assert all(abs(got[v] - x / ((n - 1) * (n - 2))) < 1e-9 for v, x in expected.items())


def test_minimal_cycles_query(spark, small):
    """Each is a cycle of its component, and none there is shorter."""
    ahead = {}
    for a, _, b in small:
        ahead.setdefault(a, set()).add(b)
    found = {}
    for r in queries()["minimal_cycles"](spark, SMALL).orderBy("scc", "step").collect():
        found.setdefault(r["scc"], []).append(r["name"])
    members = {}
    for r in queries()["find_cycles"](spark, SMALL).collect():
        members.setdefault(r["scc"], set()).add(r["name"])
    assert set(found) == set(members) and found
    for scc, cycle in found.items():
        assert set(cycle) <= members[scc] and all(b in ahead[a] for a, b in zip(cycle, [*cycle[1:], cycle[0]], strict=True))
        lengths = [min(_distances(ahead, w).get(v, 10**9) + 1 for w in ahead[v]) for v in members[scc]]
        assert len(cycle) == min(lengths)


def test_context_query(spark):
    """Greedy by (ring, side, name) at the richest level that fits."""
    g = tables.graph(spark, SMALL)
    target = next(r["name"] for r in g.nodes.collect() if r["name"].endswith(".n0"))
    rows = sorted(context.neighborhood(g, target).collect(), key=lambda r: (r["tier"], r["side"], r["name"]))
    left, expected = 400, []
    for r in rows:
        doc = (r["docstring"] or "").strip().split("\n")[0]
        where = f" ({r['file']}:{r['line']})" if r["file"] and r["line"] else ""
        levels = [("signature", f"{r['type']} {r['name']}{where}" + (f": {doc}" if doc else "")), ("summary", f"{r['type']} {r['name']}")]
        for level, text in levels[r["tier"] == 3 :]:
            n = max(1, len(text) // 4)
            if n <= left or not r["tier"]:
                left -= n
                expected.append((r["name"], level, n))
                break
    got = [(r["name"], r["level"], r["tokens"]) for r in queries()["context_pack"](spark, SMALL).collect()]
    assert got == expected


def test_node_metrics_query(spark):
    """Each column is that of its own query."""
    rows = {r["name"]: r for r in queries()["node_metrics"](spark, SMALL).collect()}
    assert len(rows) == tables.graph(spark, SMALL).nodes.count()
    for query, column in (("fan_in_out", "fan_in"), ("topological_layers", "layer"), ("kcore", "core")):
        own = dict(pairs(queries()[query](spark, SMALL), "name", column))
        assert all(rows[n][column] == own.get(n, 0) for n in rows)
    dead = {r["name"] for r in queries()["dead_code"](spark, SMALL).collect()}
    assert {n for n in rows if rows[n]["dead"]} == dead
