"""That what the graph operators shuffle, send and hold grows with the input, and that they do the whole job."""

from __future__ import annotations

import random

import pytest

from archgraph.adapters import tables
from archgraph.model import Graph
from archgraph.operators import analytics, concepts, history, report, rules, search, traverse
from archgraph.plans import queries
from tests.conftest import SMALL


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark.sparkContext._jvm
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def plans(spark, since: int = 0) -> list[str]:
    """The physical plans of the session's executions."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(since, found.size())]


def test_churn_of_entities_on_the_same_lines(spark):
    g = Graph.of(spark, [{"name": f"e{i}", "type": "method", "file": "f", "line": 1, "end_line": 10} for i in range(500)], [])
    hunks = spark.createDataFrame([(f"c{i}", "f", 5, 6) for i in range(2000)] + [("c0", "f", 1, 2), ("d", "f", 11, 12)], "commit string, file string, start_line int, end_line int")
    before = shuffled(spark)
    assert {r[1] for r in history.entity_churn(g, hunks).collect()} == {2000}
    assert shuffled(spark) - before < 500_000  # the million pairs of entities and hunks are not shuffled


def test_nodes_are_ingested_without_edges(spark):
    """Differences of nodes read no lines but to count them."""
    before = len(plans(spark))
    assert tables.graph(spark, SMALL, "o_orderkey <> 1").nodes.where("type = 'method'").count() == tables.table(spark, SMALL, "orders").count() - 1
    assert not [p for p in plans(spark, before) if "l_suppkey" in p]


def test_renames_broadcast_nothing(spark):
    def graph(infix: str) -> Graph:
        return Graph.of(spark, [{"name": f"a.b.c{i}{infix}.d{i}", "type": "method"} for i in range(50)] + [{"name": f"{infix[1:]}.p{i}", "type": "function", "content_hash": f"c{i}", "structure_hash": f"s{i}"} for i in range(9)], [])

    before = len(plans(spark))
    assert history.renames(graph(".x"), graph(".x.y")).count() == 59
    assert not [p for p in plans(spark, before) if "BroadcastExchange" in p]


@pytest.mark.parametrize("seed", range(2))
def test_kernels_in_a_task(spark, monkeypatch, seed):
    """Beyond the driver's size one task computes what the driver would, without supersteps."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    edges = sorted({(rng.choice(names), "calls", rng.choice(names)) for _ in range(50)} | {("x", "calls", "x"), ("n1", "calls", "n2"), ("n2", "calls", "n1")})
    operators = (analytics.components, analytics.layers, analytics.find_cycles, analytics.minimal_cycles, analytics.kcore, analytics.bridges, analytics.layering_violations)
    g = Graph.of(spark, [{"name": n, "type": "class"} for n in [*names, "x"]], edges)
    want = [sorted(map(tuple, f(g).collect())) for f in operators]
    ranks = {r[0]: r[1] for r in analytics.pagerank(g).collect()}, {r[0]: (r[1], r[2]) for r in analytics.hits(g).collect()}
    monkeypatch.setattr(analytics, "KERNEL_EDGES", 40)
    for name in ("_colored", "spanning_forest"):
        monkeypatch.setattr(analytics, name, None)
    assert want == [sorted(map(tuple, f(g).collect())) for f in operators]
    assert {r[0]: r[1] for r in analytics.pagerank(g).collect()} == pytest.approx(ranks[0])
    found = {r[0]: (r[1], r[2]) for r in analytics.hits(g).collect()}
    assert found.keys() == ranks[1].keys() and all(found[n] == pytest.approx(ranks[1][n], abs=2e-6) for n in found)


def test_bridges_beyond_a_task(spark, monkeypatch):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(25)}", "calls", f"n{rng.randrange(25)}") for _ in range(70)}) + [("n1", "calls", "t1"), ("t1", "calls", "t2"), ("n2", "calls", "u1")]
    g = Graph.of(spark, [], edges)
    want = sorted(map(tuple, analytics.bridges(g).collect()))
    monkeypatch.setattr(analytics, "KERNEL_EDGES", 20)
    monkeypatch.setattr(analytics, "TASK_EDGES", 55)
    assert want and want == sorted(map(tuple, analytics.bridges(g).collect()))


def test_closures_scan_once_a_level(spark, monkeypatch):
    g = Graph.of(spark, [{"name": f"n{i}", "type": "function"} for i in range(8)], [(f"n{i}", "calls", f"n{i + 1}") for i in range(7)] + [("n7", "calls", "n5")])
    before = len(plans(spark))
    want = sorted(map(tuple, traverse.closure(g, "n2", ("calls",), "out").collect()))
    assert want == [(f"n{i}", i - 2) for i in range(3, 8)]
    assert len(plans(spark, before)) < 12
    monkeypatch.setattr(traverse, "LOCAL", 3)
    assert want == sorted(map(tuple, traverse.closure(g, "n2", ("calls",), "out").collect()))


def test_hotspots_count_betweenness(spark):
    """A tree of classes beside another component; only the first can pass the threshold."""
    classes = [f"c{i}" for i in range(9)]
    edges = [(f"c{i}", "inherits", "c0") for i in range(1, 9)] + [("f", "calls", "g")]
    g = Graph.of(spark, [{"name": c, "type": "class"} for c in classes] + [{"name": x, "type": "function"} for x in "fg"], edges)
    found = {r["name"]: r["reasons"] for r in report.hotspots(g).collect()}
    assert "betweenness 0.622" in found["c0"]  # 8 * 7 of 10 * 9
    assert not any("betweenness" in found.get(c, "") for c in classes[1:])


def test_concepts_are_told_by_names(spark, monkeypatch):
    """No node or edge is shuffled for its concept; with many anchors the join gives the same."""
    g = tables.graph(spark, SMALL)
    found = concepts.crossings(g, queries.CONCEPTS)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in concepts.members(g, queries.CONCEPTS)._jdf.queryExecution().executedPlan().toString()
    want, own = sorted(map(tuple, found.collect())), sorted(map(tuple, concepts.members(g, queries.CONCEPTS).collect()))
    monkeypatch.setattr(concepts, "ANCHORS", 3)
    assert want and want == sorted(map(tuple, concepts.crossings(g, queries.CONCEPTS).collect()))
    assert own == sorted(map(tuple, concepts.members(g, queries.CONCEPTS).collect()))


def test_concepts_of_ends_that_are_no_nodes(spark):
    g = Graph.of(spark, [{"name": n, "type": "module"} for n in ("a", "b", "ab")] + [{"name": "a.x", "type": "class"}], [("a.x", "calls", "b"), ("a.x", "calls", "b.gone"), ("ab", "calls", "b")])
    groups = [concepts.Concept("a", ("a",)), concepts.Concept("b", ("b",))]
    assert [tuple(r) for r in concepts.crossings(g, groups).select("source", "target").collect()] == [("a.x", "b")]


def test_rules_ask_for_no_containment(spark):
    """Rules that don't name containment don't write it."""
    g = tables.graph(spark, SMALL, "o_orderkey <> 2")
    assert rules.check_all(g, queries.RULES, queries.CONCEPTS).count()
    assert g._found.keys() == {"nodes", "relations"}


def test_violations_are_counted(spark):
    """Witnesses of a rule are not collected into one row to be counted."""
    before = len(plans(spark))
    found = {r["rule"]: r["witnesses"] for r in queries.queries()["rule_violations"](spark, SMALL).collect()}
    assert not [p for p in plans(spark, before) if "collect_list" in p]
    assert found == {r["rule"]: len(r["witnesses"]) for r in rules.violations(tables.graph(spark, SMALL), queries.RULES, queries.CONCEPTS).collect()}


@pytest.mark.parametrize("levels", (0, 1, 2, 8))
def test_owners_are_handed_down(spark, monkeypatch, levels):
    """Shared and deep containers, a cycle, and modules in modules: as the ancestry of all says, at any number of rounds."""
    monkeypatch.setattr(traverse, "LEVELS", levels)
    chain = [(f"x{i}", "contains", f"x{i + 1}") for i in range(6)]
    edges = [("m", "contains", "x0"), *chain, ("n", "contains", "x2"), ("a", "contains", "x2"), ("m", "contains", "n"), ("x6", "contains", "x4"), ("o", "contains", "lost"), ("o", "contains", "o"), ("x6", "calls", "m")]
    g = Graph.of(spark, [{"name": n, "type": "module"} for n in "amn"] + [{"name": f"x{i}", "type": "class"} for i in range(7)] + [{"name": "o", "type": "class"}], edges)
    found = sorted(map(tuple, traverse.containing(g).collect()))
    assert found == [("a", "a"), ("m", "m"), ("n", "n"), ("x0", "m"), ("x1", "m"), *((f"x{i}", "a") for i in range(2, 7))]


def test_owners_ask_only_for_containment(spark):
    """The nearest module takes no other edge, and no pairs of all ancestors."""
    g = tables.graph(spark, SMALL, "o_orderkey <> 3")
    before = shuffled(spark)
    g.nodes, g.containment
    ingested = shuffled(spark) - before
    assert traverse.containing(g).count() == g.nodes.count()
    assert "relations" not in g._found
    ancestry = shuffled(spark)
    assert traverse.ancestry(g).count()
    assert ancestry - before - ingested < 0.7 * (shuffled(spark) - ancestry)


QUERIES = ("truncate", "trunc* NOT text", '"a file" text', "text OR trunc* NOT file", "NOT file", "NOT file OR text", "gone", "text gone", "text text OR text", "TruncFile", "NOT nothing truncate OR file")


def test_search_in_one_scan(spark, tmp_path):
    """What a search of the nodes finds in one reading, a stored index finds by its postings."""
    nodes = [("app.Truncate", "class", "truncates text of a file"), ("app.trunc_file", "function", "a file, a file"), ("app.text.TruncFile", "class", None), ("app.other", "function", "File a text"), ("...", "config", "")]
    g = Graph.of(spark, [{"name": n, "type": t, "docstring": d} for n, t, d in nodes], [])
    index = search.build_index(g)
    search.store_index(index, str(tmp_path / "index"))
    stored = search.load_index(spark, str(tmp_path / "index"))
    hits = 0
    for query in QUERIES:
        for kind in (None, "class"):
            one, other = (sorted(map(tuple, search.search(i, g, query, kind, None).collect())) for i in (index, stored))
            assert one == other, query
            hits += len(one)
    assert hits > 20


@pytest.mark.parametrize("name", ("search_bm25", "search_any"))
def test_search_reads_no_edges_and_shuffles_no_postings(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "_STORED", {})
    before, began = shuffled(spark), len(plans(spark))
    assert queries.queries()[name](spark, SMALL).count()
    g = tables.graph(spark, SMALL)
    assert not g._found  # neither nodes nor edges had to be written
    assert shuffled(spark) - before < 300_000
    assert sum("documents.parquet" in p for p in plans(spark, began)) == 1
