"""Command line: python -m archgraph --graph DIR COMMAND ...

The graph lies below --graph as Parquet, with rules and concepts beside it. Exit codes: 0 fine,
1 rules are violated, 2 wrong use or data.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from archgraph.model import COUPLING, Graph
from archgraph.operators import analytics, concepts, context, history, oo, report, rules, search, select, traverse
from archgraph.sources import code, export, git, stored
from archgraph.store import cut

METRICS = {
    "cycles": analytics.find_cycles, "layers": analytics.layers, "layering": analytics.layering_violations, "pagerank": analytics.pagerank, "hits": analytics.hits, "kcore": analytics.kcore,
    "bridges": analytics.bridges, "betweenness": analytics.betweenness, "fan": analytics.fan_in_out, "classes": report.class_metrics, "martin": oo.martin, "sdp": oo.sdp_violations,
    "god-classes": oo.god_classes, "god-files": oo.god_files, "envy": oo.feature_envy, "shotgun": oo.shotgun_surgery, "dead": oo.dead_code, "hotspots": report.hotspots, "innermost": analytics.innermost, "nodes": report.node_metrics,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="archgraph", description=__doc__)
    p.add_argument("--graph", required=True, help="folder of the stored graph")
    p.add_argument("--limit", type=int, default=20, help="rows to show; 0: all")
    p.add_argument("--json", action="store_true", help="one JSON object a row")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **options: dict) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", **v)
        return c

    add("scan", "root", exclude={"action": "append", "default": []}, since={})
    for name in ("status", "validate", "overview", "rules", "concepts", "concept-report"):
        add(name)
    add("list", type={}, scope={})
    for name in ("about", "outgoing", "incoming", "usages", "containment", "context"):
        add(name, "name")
    for name in ("deps", "callers", "impact", "ancestors", "descendants"):
        add(name, "name", depth={"type": int})
    add("path", "name", "other")
    add("subgraph", "name", depth={"type": int, "default": 2}, rel={"action": "append"})
    add("analyze", "metric", scope={}).add_argument("--top", type=int, default=0)
    add("search", "text", kind={})
    add("diff", "other")
    add("churn", "root", days={"type": int, "default": 90})
    add("blame", "root", "file")
    add("export", "format", level={"default": "module"})
    add("check")
    add("rule-add", "name", deny={}, invariant={}, forall={}, assertion={}, scope={})
    add("rule-rm", "name")
    add("concept-add", "name", prefix={"action": "append", "required": True}, sync={"action": "append", "default": []})
    add("concept-rm", "name")
    add("sync-add", "name", "point")
    add("sync-rm", "name", "point")
    add("batch", "file")
    return p


def _declared(read, spark: SparkSession, path: str) -> list:
    try:
        return read(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def run(spark: SparkSession, o: argparse.Namespace) -> tuple[DataFrame | None, int]:
    base = o.graph.rstrip("/")
    if o.command == "scan":
        try:
            before: Graph | None = stored.read_parquet(spark, f"{base}/graph")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            before = None
        sources = there = code.files(spark, o.root, tuple(o.exclude))
        if o.since:
            sources = sources.join(git.changed_files(spark, o.root, o.since), "path", "left_semi")
        gone = None
        if before is not None:  # files of earlier scans that are no more
            gone = before.nodes.where("file is not null and provenance = 'scan'").selectExpr("file as path").distinct().join(there.select("path"), "path", "left_anti")
        after, skipped = code.scan(sources, into=before, gone=gone)
        if before is not None:
            for r in code.orphans(before, after).limit(o.limit or 1000).collect():
                print(f"lost: {r['source']} -[{r['rel']}]-> {r['target']}: {r['reason']}", file=sys.stderr)
        stored.write_parquet(code.stamp_fans(after), f"{base}/next")
        stored.write_parquet(stored.read_parquet(spark, f"{base}/next"), f"{base}/graph")
        return code.diagnosis(skipped), 0
    kept_rules = _declared(stored.read_rules, spark, f"{base}/rules")
    kept_concepts = _declared(stored.read_concepts, spark, f"{base}/concepts")
    if o.command in ("rule-add", "rule-rm"):
        left = [r for r in kept_rules if r.name != o.name]
        if o.command == "rule-add":
            if sum(map(bool, (o.deny, o.invariant, o.forall))) != 1:
                raise rules.RuleError("one of --deny, --invariant and --forall")
            left.append(rules.Rule(o.name, "deny" if o.deny else "invariant" if o.invariant else "quantified", o.deny, o.invariant, o.forall, o.assertion, {}, o.scope))
            rules.validate_rule(left[-1])
        stored.write_rules(spark, left, f"{base}/rules")
        return None, 0
    if o.command in ("concept-add", "concept-rm"):
        left_c = [c for c in kept_concepts if c.name != o.name]
        if o.command == "concept-add":
            left_c.append(concepts.Concept(o.name, tuple(dict.fromkeys(o.prefix)), tuple(dict.fromkeys(o.sync))))
        stored.write_concepts(spark, left_c, f"{base}/concepts")
        return None, 0
    if o.command in ("sync-add", "sync-rm"):
        if o.name not in {c.name for c in kept_concepts}:
            raise LookupError(f"no such concept: {o.name}")
        change = lambda c: tuple(dict.fromkeys([*c.sync_points, o.point])) if o.command == "sync-add" else tuple(x for x in c.sync_points if x != o.point)
        stored.write_concepts(spark, [concepts.Concept(c.name, c.prefixes, change(c)) if c.name == o.name else c for c in kept_concepts], f"{base}/concepts")
        return None, 0
    if o.command == "rules":
        return spark.createDataFrame([(r.name, r.type, r.pattern or r.invariant or f"{r.selector}: {r.assertion}", r.scope) for r in kept_rules], "name string, type string, what string, scope string"), 0
    if o.command == "concepts":
        return spark.createDataFrame([(c.name, list(c.prefixes), list(c.sync_points)) for c in kept_concepts], "name string, prefixes array<string>, sync_points array<string>"), 0
    g = stored.read_parquet(spark, f"{base}/graph")
    if getattr(o, "scope", None):
        g = g.scope(o.scope)
    name = select.one(g, o.name) if getattr(o, "name", None) else ""
    if o.command == "check":
        found = cut(rules.violations(g, kept_rules, kept_concepts), "violations")
        return found, int(not found.isEmpty())
    if o.command == "validate":
        broken = g.validate()
        return broken, 0 if broken.isEmpty() else 2
    if o.command == "batch":
        schema = "seq long, op string, name string, type string, docstring string, source string, rel string, target string"
        after, errors = stored.apply_batch(g, spark.read.schema(schema).json(o.file))
        stored.write_parquet(after, f"{base}/next")
        stored.write_parquet(stored.read_parquet(spark, f"{base}/next"), f"{base}/graph")
        return errors, 0
    if o.command == "analyze":
        found = METRICS[o.metric](g)
        ranked = next((c for c in ("score", "pagerank", "betweenness", "hub", "core", "wmc", "fan_out", "distance") if c in found.columns), None)
        return (found.orderBy(found[ranked].desc(), found.columns[0]) if ranked else found), 0
    rels = tuple(o.rel) if getattr(o, "rel", None) else None
    return {
        "status": lambda: select.status(g), "overview": lambda: select.overview(g), "list": lambda: (select.nodes_of_type(g, o.type) if o.type else g.nodes).select("name", "type", "file", "line").orderBy("name"),
        "about": lambda: select.about(g, name), "outgoing": lambda: select.incident(g, name, "out"), "incoming": lambda: select.incident(g, name, "in"), "usages": lambda: select.usages(g, name),
        "containment": lambda: traverse.containment_path(g, name), "context": lambda: context.pack(g, name), "deps": lambda: traverse.transitive_deps(g, name, max_depth=o.depth),
        "callers": lambda: traverse.transitive_callers(g, name, o.depth), "impact": lambda: traverse.impact(g, name, COUPLING, o.depth), "ancestors": lambda: traverse.ancestors(g, name, max_depth=o.depth),
        "descendants": lambda: traverse.descendants(g, name, max_depth=o.depth), "path": lambda: traverse.shortest_path(g, name, select.one(g, o.other)),
        "subgraph": lambda: traverse.subgraph(g, name, o.depth, "both", rels).edges.select("source", "rel", "target"), "search": lambda: search.search(search.build_index(g), g, o.text, o.kind, None),
        "diff": lambda: history.diff(stored.read_parquet(spark, f"{o.other.rstrip('/')}/graph"), g), "churn": lambda: history.entity_churn(g, history.hunks_from_git(spark, o.root, o.days)),
        "blame": lambda: git.blame(g, o.root, o.file), "concept-report": lambda: concepts.summary(g, kept_concepts),
        "export": lambda: {"json": export.to_json, "text": export.to_text, "mermaid": export.to_mermaid, "dot": export.to_dot, "dsm": lambda g: export.to_dsm(g, o.level)}[o.format](g),
    }[o.command](), 0


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("archgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        found, status = run(spark, o)
    except (LookupError, ValueError, git.GitError) as e:
        print(f"archgraph: {e}", file=sys.stderr)
        return 2
    if found is not None:
        if "line" in found.columns and "part" in found.columns:
            for r in found.toLocalIterator():
                print(r["line"])
            return status
        total = found.count()
        shown = found.limit(o.limit) if o.limit else found
        if o.json:
            for line in shown.toJSON().toLocalIterator():
                print(line)
            print(json.dumps({"total": total, "displayed": min(total, o.limit or total)}))
        else:
            shown.show(o.limit or max(total, 1), truncate=60)
            print(f"{min(total, o.limit or total)} of {total}")
    return status


if __name__ == "__main__":
    sys.exit(main())
