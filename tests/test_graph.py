"""Small graphs with answers worked out by hand, and random graphs against plain Python."""

from __future__ import annotations

import random

import pytest

from archgraph.model import Graph
from archgraph.operators import analytics, concepts, context, history, oo, rules, search, select, traverse
from archgraph.sources import export, stored


def build(spark, edges, types=None, **more):
    types = types or {}
    names = sorted({x for e in edges for x in (e[0], e[2])} | set(types))
    return Graph.of(spark, [{"name": n, "type": types.get(n, "function"), **more.get(n, {})} for n in names], edges)


def calls(*pairs):
    return [(a, "calls", b) for a, b in (p.split(">") for p in pairs)]


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    return build(spark, calls("a>b", "b>c", "c>d"))


def test_traversal(spark, chain):
    assert pairs(traverse.transitive_callers(chain, "d"), "name") == [("a",), ("b",), ("c",)]
    assert pairs(traverse.transitive_callers(chain, "d", 1), "name") == [("c",)]
    assert pairs(traverse.shortest_path(chain, "a", "d"), "step", "name") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert pairs(traverse.shortest_path(chain, "a", "a"), "name") == [("a",)] and not traverse.shortest_path(chain, "a", "zzz").collect()
    sub = traverse.subgraph(chain, "b", 1)
    assert pairs(sub.nodes, "name") == [("a",), ("b",), ("c",)] and sub.edges.count() == 2
    assert traverse.subgraph(chain, "b", 0).edges.count() == 0
    loop = build(spark, calls("a>b", "b>a"))
    assert pairs(traverse.transitive_callers(loop, "a"), "name") == [("b",)]
    deps = build(spark, [("app", "depends_on", "lib"), ("lib", "depends_on", "core")], dict.fromkeys(("app", "lib", "core"), "module"))
    assert pairs(traverse.transitive_deps(deps, "app"), "name") == [("core",), ("lib",)]


def test_containment(spark):
    g = build(spark, [("p", "contains", "p.m"), ("p.m", "contains", "p.m.C"), ("p.m.C", "contains", "p.m.C.f")], {"p": "package", "p.m": "module", "p.m.C": "class", "p.m.C.f": "method"})
    assert pairs(traverse.containment_path(g, "p.m.C.f"), "depth", "name") == [(0, "p.m.C.f"), (1, "p.m.C"), (2, "p.m"), (3, "p")]
    assert pairs(traverse.module_members(g), "module", "name") == [("p", "p.m"), ("p", "p.m.C"), ("p", "p.m.C.f"), ("p.m", "p.m.C"), ("p.m", "p.m.C.f")]
    assert dict(pairs(traverse.containing(g), "name", "owner"))["p.m.C.f"] == "p.m"
    assert pairs(select.resolve(g, spark.createDataFrame([("C",), ("p.m",), ("x",)], "query string")), "query", "name") == [("C", "p.m.C"), ("p.m", "p.m")]
    ring = build(spark, [("x", "contains", "y"), ("y", "contains", "x")])
    assert pairs(traverse.containment_path(ring, "x"), "name") == [("x",), ("y",)]


@pytest.mark.parametrize("distributed", [False, True])
def test_cycles_and_layers(spark, distributed):
    g = build(spark, calls("a>b", "b>a", "c>d", "d>e", "e>c", "b>c", "x>x", "y>a"))
    assert pairs(analytics.find_cycles(g, distributed), "scc", "name") == [("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("c", "e")]
    assert dict(pairs(analytics.layers(g, distributed), "name", "layer")) == {"c": 0, "d": 0, "e": 0, "a": 1, "b": 1, "y": 2, "x": 0}
    diamond = build(spark, calls("a>b", "a>c", "b>d", "c>d"))
    assert dict(pairs(analytics.layers(diamond, distributed), "name", "layer")) == {"d": 0, "b": 1, "c": 1, "a": 2}
    assert analytics.find_cycles(build(spark, [("a", "contains", "b"), ("b", "contains", "a")]), distributed).count() == 0


def test_minimal_cycles_and_layering(spark):
    g = build(spark, calls("a>b", "b>c", "c>a", "c>d", "d>c"))
    assert pairs(analytics.minimal_cycles(g), "step", "name") == [(0, "c"), (1, "d")]
    assert len(analytics.layering_violations(g).collect()) == 5


def _random(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(rng.randrange(3, 16))]
    return sorted({(a, rng.choice(["calls", "imports", "inherits", "depends_on"]), b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(rng.randrange(2, 30))) if a != b})


@pytest.mark.parametrize("seed", range(1))
def test_kernels_and_supersteps_agree(spark, seed):
    g = build(spark, _random(seed))
    for f, columns in ((analytics.components, ("name", "scc")), (analytics.layers, ("name", "layer")), (analytics.kcore, ("name", "core"))):
        assert pairs(f(g), *columns) == pairs(f(g, distributed=True), *columns)
    for f, columns in ((lambda **k: analytics.pagerank(g, rounds=3, **k), ("pagerank",)), (lambda **k: analytics.hits(g, rounds=2, **k), ("hub", "authority"))):
        a, b = ({r["name"]: [r[c] for c in columns] for r in f(distributed=d).collect()} for d in (False, True))
        assert a.keys() == b.keys() and all(a[n] == pytest.approx(b[n], abs=2e-6) for n in a)


def test_pagerank_sums_to_one(spark, chain):
    assert sum(r["pagerank"] for r in analytics.pagerank(chain).collect()) == pytest.approx(1)
    assert analytics.pagerank(build(spark, [("a", "contains", "b")])).collect() == []


def test_cores_bridges_betweenness(spark):
    g = build(spark, calls("a>b", "b>c", "c>a", "c>p"))
    assert dict(pairs(analytics.kcore(g), "name", "core")) == {"a": 2, "b": 2, "c": 2, "p": 1}
    assert pairs(analytics.bridges(g), "a", "b") == [("c", "p")]
    path = build(spark, calls("a>b", "b>c"))
    assert pairs(analytics.bridges(path), "a", "b") == [("a", "b"), ("b", "c")]
    assert dict(pairs(analytics.betweenness(path), "name", "betweenness")) == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert analytics.betweenness(path, include=False).collect() == []
    assert dict(pairs(analytics.fan_in_out(g), "name", "fan_in"))["p"] == 1


CLASSES = [
    ("ma", "contains", "ma.A"), ("ma", "contains", "ma.C"), ("ma.A", "contains", "ma.A.m1"), ("ma.A", "contains", "ma.A.m2"), ("ma.A", "contains", "ma.A.m3"),
    ("mb", "contains", "mb.B"), ("mb.B", "contains", "mb.B.b1"), ("mb.B", "contains", "mb.B.b2"), ("mb", "contains", "mb.util"),
    ("ma.C", "inherits", "ma.A"), ("ma.A.m1", "calls", "mb.B.b1"), ("ma.A.m1", "calls", "mb.B.b2"), ("ma.A.m2", "calls", "ma.A.m3"), ("mb", "imports", "ma"),
]


@pytest.fixture(scope="module")
def code(spark):
    types = {"ma": "module", "mb": "module", "ma.A": "class", "ma.C": "class", "mb.B": "class", "mb.util": "function"} | dict.fromkeys(("ma.A.m1", "ma.A.m2", "ma.A.m3", "mb.B.b1", "mb.B.b2"), "method")
    cc = {"ma.A.m1": 2, "ma.A.m2": 3, "ma.A.m3": 5, "mb.B.b1": 1}
    return build(spark, CLASSES, types, **{n: {"cc": v, "file": "a.py"} for n, v in cc.items()})


def test_oo_metrics(code):
    assert pairs(oo.wmc(code), "class", "wmc", "max_method_cc") == [("ma.A", 10, 5), ("ma.C", 0, 0), ("mb.B", 2, 1)]
    assert pairs(oo.dit(code), "class", "dit") == [("ma.A", 0), ("ma.C", 1), ("mb.B", 0)]
    assert pairs(oo.noc(code), "class", "noc") == [("ma.A", 1), ("ma.C", 0), ("mb.B", 0)]
    assert pairs(oo.cbo(code), "class", "cbo") == [("ma.A", 2), ("ma.C", 1), ("mb.B", 1)]
    assert pairs(oo.rfc(code), "class", "rfc") == [("ma.A", 6), ("ma.C", 0), ("mb.B", 2)]
    assert pairs(oo.lcom4(code), "class", "lcom4") == [("ma.A", 2), ("ma.C", 0), ("mb.B", 2)]
    assert pairs(oo.martin(code), "module", "ca", "ce", "instability", "distance") == [("ma", 1, 1, 0.5, 0.5), ("mb", 1, 1, 0.5, 0.5)]
    assert pairs(oo.feature_envy(code), "method", "envied", "own_refs", "external_refs") == [("ma.A.m1", "mb.B", 0, 2)]
    assert pairs(oo.god_classes(code, 5, 1, 2), "class") == [("ma.A",)]
    assert pairs(oo.shotgun_surgery(code, 2), "name", "fan_out") == [("ma.A.m1", 2)]


def test_dit_on_a_cycle_and_below(spark):
    g = build(spark, [("a", "inherits", "b"), ("b", "inherits", "a"), ("c", "inherits", "a"), ("a", "inherits", "r")], dict.fromkeys("abcr", "class"))
    assert pairs(oo.dit(g), "class", "dit") == [("a", 1), ("b", 0), ("c", 2), ("r", 0)]


def test_sdp(spark):
    g = build(spark, [("s", "imports", "u"), ("x", "imports", "s"), ("y", "imports", "s"), ("u", "imports", "v")], dict.fromkeys("suxyv", "module"))
    assert ("s", "u") in pairs(oo.sdp_violations(g), "source", "target")


def test_dead_code(spark):
    g = build(spark, [("main", "calls", "used"), ("C", "contains", "C.f"), ("m", "contains", "lonely")], {"orphan": "function", "C": "class", "C.f": "method", "m": "module", "LIMIT": "constant", "test_x": "function"})
    assert pairs(oo.dead_code(g), "name") == [("C",), ("C.f",), ("orphan",)]
    assert pairs(oo.dead_code(g, spark.createDataFrame([("orphan",)], "name string")), "name") == [("C",), ("C.f",)]


def test_rules(spark):
    g = build(spark, [("ui.app", "calls", "db.query"), ("core.lib", "imports", "util.helpers")])
    assert pairs(rules.check_deny(g, "ui.* -[calls]-> db.*"), "source", "target") == [("ui.app", "db.query")]
    assert rules.check_deny(g, "ui.* -> db.*", scope="core").count() == 0 and rules.check_deny(g, "core.* -> db.*").count() == 0
    assert pairs(rules.check_quantified(g, "*", "fan_out <= 0"), "name") == [("core.lib",), ("ui.app",)]
    assert rules.check_quantified(g, "nothing.*", "fan_out <= 0").count() == 0
    for bad in ("fan_out", "fan_out <", "nonsense > 1", "f(1)", "1 < fan_in < 3", "wmc > 1"):
        with pytest.raises(rules.RuleError):
            rules.check_quantified(g, "*", bad).collect()
    found = rules.check_all(g, [rules.Rule("d", "deny", pattern="ui.* -> db.*"), rules.Rule("c", "invariant", invariant="no-cycles"), rules.Rule("n", "invariant", invariant="no-dead-code", params={"entry_points": "ui.*, core.*"})])
    assert pairs(found, "rule", "witness") == [("d", "ui.app -[calls]-> db.query")]
    with pytest.raises(rules.RuleError):
        rules.check(g, rules.Rule("x", "invariant", invariant="unknown"))
    loop = build(spark, calls("a>b", "b>a"))
    assert pairs(rules.check(loop, rules.Rule("c", "invariant", invariant="no-cycles")), "witness") == [("a -> b",)]


def test_concepts(spark):
    types = {"app.ui": "module", "app.core": "module"}
    g = build(spark, [*((m, "contains", f"{m}.{x}") for m, x in (("app.ui", "render"), ("app.ui", "helper"), ("app.ui", "sync_port"), ("app.core", "compute"))), ("app.ui.render", "calls", "app.ui.helper"), ("app.ui.render", "calls", "app.core.compute"), ("app.ui.sync_port", "calls", "app.core.compute")], types)
    groups = [concepts.Concept("ui", ("app.ui",), ("app.ui.sync_port",)), concepts.Concept("core", ("app.core",))]
    ui = next(r for r in concepts.summary(g, groups).collect() if r["concept"] == "ui")
    assert (ui["members"], ui["internal"], ui["cross_out"], ui["sync_density"], ui["sync_asymmetry"]) == (4, 1, 2, pytest.approx(2 / 3, abs=1e-6), 1.0)
    assert pairs(concepts.dependencies(g, groups), "from_concept", "to_concept", "edges", "unsanctioned", "rels") == [("ui", "core", 2, 1, "calls:2")]
    with pytest.raises(ValueError):
        concepts.members(g, [*groups, concepts.Concept("all", ("app.ui",))])


def test_mutations(spark):
    g = Graph.of(spark, [{"name": "a", "type": "class", "file": "f", "metadata": '{"x":"1","y":"2"}'}, {"name": "b", "type": "function"}], [("a", "calls", "b")])
    g2 = g.upsert(spark.createDataFrame([("a", "module", None, '{"y":"3"}'), ("c", "class", "g", None)], "name string, type string, file string, metadata string"))
    rows = {r["name"]: r for r in g2.nodes.collect()}
    assert (rows["a"]["type"], rows["a"]["file"], rows["c"]["file"]) == ("module", "f", "g") and '"y":"3"' in rows["a"]["metadata"] and '"x":"1"' in rows["a"]["metadata"]
    with pytest.raises(KeyError):
        g.link(spark.createDataFrame([("a", "calls", "zzz")], "source string, rel string, target string"))
    g3 = g2.link(spark.createDataFrame([("c", "calls", "a"), ("a", "calls", "b")], "source string, rel string, target string"))
    assert g3.edges.count() == 2
    g4 = g3.remove(spark.createDataFrame([("a",)], "name string"))
    assert g4.edges.count() == 0 and g4.validate().count() == 0
    with pytest.raises(KeyError):
        g4.unlink(spark.createDataFrame([("a", "calls", "b")], "source string, rel string, target string"))
    broken = Graph(g.nodes.where("name = 'a'"), g.edges)
    assert pairs(broken.validate(), "missing") == [("b",)]


def test_batch(spark):
    g = Graph.of(spark, [{"name": "a", "type": "class"}, {"name": "b", "type": "class"}], [("a", "calls", "b")])
    ops = [(1, "add", "c", "function", None, None, None, None), (2, "link", None, None, None, "c", "calls", "a"), (3, "unlink", None, None, None, "a", "calls", "b"), (4, "update", "zzz", None, "d", None, None, None), (5, "link", None, None, None, "c", "calls", "q"), (6, "update", "b", None, "doc", None, None, None)]
    new, errors = stored.apply_batch(g, spark.createDataFrame(ops, "seq int, op string, name string, type string, docstring string, source string, rel string, target string"))
    assert pairs(new.edges, "source", "target") == [("c", "a")] and errors.count() == 2
    assert {r["name"]: r["docstring"] for r in new.nodes.collect()} == {"a": None, "b": "doc", "c": None}


def test_diff_and_renames(spark):
    old = Graph.of(spark, [{"name": "a", "type": "class", "line": 1}, {"name": "gone", "type": "function", "content_hash": "1", "structure_hash": "s"}, {"name": "app.utils.parse_config", "type": "function"}, {"name": "t", "type": "function", "structure_hash": "q", "content_hash": "x"}], [("a", "calls", "gone")])
    new = Graph.of(spark, [{"name": "a", "type": "module", "line": 2}, {"name": "came", "type": "function", "content_hash": "1", "structure_hash": "s"}, {"name": "app.utils.helpers.parse_config", "type": "function"}, {"name": "u", "type": "function", "structure_hash": "q", "content_hash": "y"}], [("a", "calls", "came")])
    changes = pairs(history.diff_nodes(old, new).na.fill("-"), "name", "change", "field")
    assert ("a", "changed", "type") in changes and ("a", "changed", "line") in changes and ("gone", "removed", "-") in changes and ("came", "added", "-") in changes
    assert pairs(history.renames(old, new), "old_name", "new_name", "kind") == [("app.utils.parse_config", "app.utils.helpers.parse_config", "fuzzy"), ("gone", "came", "content"), ("t", "u", "structure")]
    assert pairs(history.diff_edges(old, new), "target", "change") == [("came", "added"), ("gone", "removed")]


def test_churn(spark):
    text = "commit 0123456789abcdef\n+++ b/f.py\n@@ -10,3 +10,5 @@\n@@ -30 +30,0 @@\n@@ -1,0 +12 @@\ncommit fedcba9876543210\n+++ b/f.py\n@@ -1 +14,2 @@\n@@ -1 +0,0 @@\n"
    hunks = list(history.parse_unified_diff(text))
    assert hunks[0] == ("0123456789ab", "f.py", 10, 14) and hunks[2] == ("0123456789ab", "f.py", 12, 12) and len(hunks) == 4
    g = Graph.of(spark, [{"name": "f", "type": "function", "file": "f.py", "line": 13, "end_line": 20}, {"name": "g", "type": "function", "file": "f.py", "line": 100, "end_line": 900}], [])
    df = spark.createDataFrame([*hunks, ("c", "f.py", 890, 2000)], "commit string, file string, start_line int, end_line int")
    assert pairs(history.entity_churn(g, df), "name", "touches") == [("f", 2), ("g", 1)]
    assert pairs(history.file_churn(df), "file", "hunks") == [("f.py", 5)]


def test_search(spark):
    g = Graph.of(spark, [{"name": "app.truncateText", "type": "function", "docstring": "Cut a text short."}, {"name": "app.Truncate", "type": "class"}, {"name": "app.other", "type": "function", "docstring": "No truncate here, only much else to be read"}, {"name": "x.y", "type": "module"}], [])
    index = search.build_index(g)
    hits = [r["name"] for r in search.search(index, g, "truncate").collect()]
    assert set(hits) == {"app.truncateText", "app.Truncate", "app.other"} and hits[-1] == "app.other"
    assert [r["name"] for r in search.search(index, g, "truncate", kind="class").collect()] == ["app.Truncate"]
    assert {r["name"] for r in search.search(index, g, "trunc* NOT text").collect()} == {"app.Truncate", "app.other"}
    assert len(search.search(index, g, "truncate", limit=1).collect()) == 1 and search.search(index, g, "nowhere").count() == 0


def test_context(spark, chain):
    rows = context.pack(chain, "b", 1000).orderBy("position").collect()
    assert [r["name"] for r in rows] == ["b", "c", "a", "d"] and rows[0]["tier"] == 0
    assert [r["name"] for r in context.pack(chain, "b", 1).collect()] == ["b"]
    assert context.pack(chain, "b", 1000, source=lambda n: f"def {n}(): ...").where("position = 0").collect()[0]["level"] == "full"


def test_export_and_storage(spark, code, tmp_path):
    assert pairs(export.dsm_cells(code), "row", "col", "n") == [("ma", "mb", 2), ("mb", "ma", 1)]
    wide = {r["row"]: r.asDict() for r in export.to_dsm(code).collect()}
    assert wide["ma"]["mb"] == 2 and wide["ma"]["ma"] == 0
    lines = [r["line"] for r in export.to_mermaid(code).collect()]
    assert lines[0] == "graph LR" and "    ma_A -->|contains| ma_A_m1" in lines
    assert [r["line"] for r in export.to_dot(code).collect()][-1] == "}"
    assert any("[class] ma.A" in r["line"] for r in export.to_text(code).collect())
    stored.write_jsonl(code, str(tmp_path / "g"))
    back = stored.read_jsonl(spark, str(tmp_path / "g"))
    assert pairs(back.edges, "source", "rel", "target") == pairs(code.edges, "source", "rel", "target")
    assert {r["name"]: r["cc"] for r in back.nodes.collect()} == {r["name"]: r["cc"] for r in code.nodes.collect()}
    stored.write_parquet(code, str(tmp_path / "p"))
    assert pairs(stored.read_parquet(spark, str(tmp_path / "p")).edges, "source", "rel", "target") == pairs(code.edges, "source", "rel", "target")
    rs = [rules.Rule("a", "deny", pattern="x -> y"), rules.Rule("b", "invariant", invariant="no-cycles", params={"k": "v"})]
    stored.write_rules(spark, rs, str(tmp_path / "r"))
    assert stored.read_rules(spark, str(tmp_path / "r")) == rs
    cs = [concepts.Concept("c", ("a", "b"), ("a.s",))]
    stored.write_concepts(spark, cs, str(tmp_path / "c"))
    assert stored.read_concepts(spark, str(tmp_path / "c")) == cs


def test_globs(spark):
    names = ["a.b", "a.bc", "a_b", "ab", "a.[x]", "A.b", "a.\nb"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    import fnmatch

    for pattern in ("a.*", "a?b", "*b", "a.[bc]*", "a.[!b]*", "a.b", "[aA].b", "*.[[]x]"):
        got = sorted(r[0] for r in df.where(select.glob(df["name"], pattern)).collect())
        assert got == sorted(n for n in names if fnmatch.fnmatchcase(n, pattern)), pattern
