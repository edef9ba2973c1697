"""Declarative rules: denied edges, invariants, and quantified assertions over metrics.

Assertions are parsed once on the driver, checked against the known identifiers, and compiled
to Spark columns; only the metrics that they name are computed.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.model import COUPLING, Graph, under
from archgraph.operators import analytics, concepts, oo
from archgraph.operators.select import glob

INVARIANTS = ("no-cycles", "no-dead-code", "no-layering-violations", "concept-boundaries")


@dataclass(frozen=True)
class Rule:
    """type: deny (pattern), invariant (invariant, params) or quantified (selector, assertion)."""

    name: str
    type: str
    pattern: str | None = None
    invariant: str | None = None
    selector: str | None = None
    assertion: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    scope: str | None = None


class RuleError(ValueError):
    pass


def parse_deny(pattern: str) -> tuple[str, tuple[str, ...], str]:
    """Of `a -> b` (any coupling) or `a -[rel]-> b`: source glob, relationships, target glob."""
    left, arrow, right = pattern.partition("->")
    if not arrow or not left.strip() or not right.strip():
        raise RuleError(f"not a pattern: {pattern!r}")
    left, rels = left.strip(), COUPLING
    if left.endswith("]") and "-[" in left:
        left, _, rel = left[:-1].rpartition("-[")
        rels = (rel.strip(),)
    return left.strip(), rels, right.strip()


def check_deny(g: Graph, pattern: str, scope: str | None = None) -> DataFrame:
    """(source, rel, target) of every edge that the pattern forbids; a scope restricts the sources."""
    a, rels, b = parse_deny(pattern)
    edges = g.edges if "contains" in rels else g.relations
    hits = edges.where(F.col("rel").isin(*rels)).where(glob(F.col("source"), a) & glob(F.col("target"), b))
    if scope:
        hits = hits.where(under(F.col("source"), scope))
    return hits.select("source", "rel", "target")


# Assertions

_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}


def parse_assertion(text: str) -> tuple[ast.expr, set[str]]:
    """The tree and its identifiers: literals, names, not + -, + - * /, one comparison, and/or."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"not an assertion: {text!r}") from e
    names: set[str] = set()

    def walk(n: ast.expr) -> None:
        if isinstance(n, ast.Constant) and isinstance(n.value, bool | int | float | str):
            return
        if isinstance(n, ast.Name):
            names.add(n.id)
        elif isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.Not | ast.UAdd | ast.USub):
            walk(n.operand)
        elif isinstance(n, ast.BinOp) and type(n.op) in _ARITHMETIC:
            walk(n.left)
            walk(n.right)
        elif isinstance(n, ast.Compare) and len(n.ops) == 1 and type(n.ops[0]) in _COMPARE:
            walk(n.left)
            walk(n.comparators[0])
        elif isinstance(n, ast.BoolOp):
            for v in n.values:
                walk(v)
        else:
            raise RuleError(f"not allowed in an assertion: {ast.unparse(n)}")

    walk(tree)
    return tree, names


def compile_assertion(tree: ast.expr) -> Column:
    if isinstance(tree, ast.Constant):
        return F.lit(tree.value)
    if isinstance(tree, ast.Name):
        return F.col(f"`{tree.id}`")
    if isinstance(tree, ast.UnaryOp):
        x = compile_assertion(tree.operand)
        return ~x if isinstance(tree.op, ast.Not) else -x if isinstance(tree.op, ast.USub) else x
    if isinstance(tree, ast.BinOp):
        return _ARITHMETIC[type(tree.op)](compile_assertion(tree.left), compile_assertion(tree.right))
    if isinstance(tree, ast.Compare):
        return _COMPARE[type(tree.ops[0])](compile_assertion(tree.left), compile_assertion(tree.comparators[0]))
    if not isinstance(tree, ast.BoolOp):
        raise RuleError(f"not allowed in an assertion: {ast.unparse(tree)}")
    out = compile_assertion(tree.values[0])
    for v in tree.values[1:]:
        out = out & compile_assertion(v) if isinstance(tree.op, ast.And) else out | compile_assertion(v)
    return out


Metric = Callable[[Graph], DataFrame]


def _renamed(key: str, *columns: str) -> Callable[[Callable[[Graph], DataFrame]], Metric]:
    return lambda f: lambda g: f(g).select(F.col(key).alias("name"), *columns)


#: Total over all nodes (0 where a metric has no row), then those of classes and modules only.
NODE_METRICS: dict[str, Metric] = {
    "fan_in": analytics.fan_in_out,
    "fan_out": analytics.fan_in_out,
    "pagerank": analytics.pagerank,
    "betweenness": analytics.betweenness,
    "core": analytics.kcore,
    "hub": analytics.hits,
    "authority": analytics.hits,
    "dead": lambda g: oo.dead_code(g).select("name", F.lit(True).alias("dead")),
    "in_cycle": lambda g: analytics.find_cycles(g).select("name", F.lit(True).alias("in_cycle")),
}
ATTRIBUTES = {"name", "type", "file", "line", "end_line", "cc"}
TYPED_METRICS: dict[str, tuple[tuple[str, ...], Metric]] = {
    **{m: (("class",), _renamed("class", m)(f)) for m, f in (("wmc", oo.wmc), ("max_method_cc", oo.wmc), ("dit", oo.dit), ("noc", oo.noc), ("cbo", oo.cbo), ("rfc", oo.rfc), ("lcom4", oo.lcom4))},
    **{m: (("module", "package"), _renamed("module", m)(oo.martin)) for m in ("ca", "ce", "instability", "abstractness", "distance")},
    "layer": (("*",), analytics.layers),
}


def parse_quantified(assertion: str) -> tuple[ast.expr, set[str]]:
    """The tree and its identifiers, all of them known."""
    tree, names = parse_assertion(assertion)
    unknown = names - ATTRIBUTES - set(NODE_METRICS) - set(TYPED_METRICS)
    if unknown:
        raise RuleError(f"unknown in assertion: {', '.join(sorted(unknown))}")
    return tree, names


def validate_rule(rule: Rule) -> None:
    """Raises where a rule can't be evaluated, whatever the graph."""
    if rule.type == "quantified":
        parse_quantified(rule.assertion or "")
    elif rule.type == "deny":
        parse_deny(rule.pattern or "")
    elif rule.type != "invariant":
        raise RuleError(f"unknown type of rule: {rule.type!r}")
    elif rule.invariant not in INVARIANTS:
        raise RuleError(f"unknown invariant: {rule.invariant!r}")


def check_quantified(g: Graph, selector: str, assertion: str, scope: str | None = None) -> DataFrame:
    """Subjects that break the assertion: name and the metrics that it names. Facts come from the whole graph."""
    tree, names = parse_quantified(assertion)
    subjects = g.nodes.where(glob(F.col("name"), selector))
    if scope:
        subjects = subjects.where(under(F.col("name"), scope))
    for name in sorted(names & set(TYPED_METRICS)):
        kinds, metric = TYPED_METRICS[name]
        subjects = subjects.join(metric(g).select("name", name), "name", "left")
        if not subjects.where(F.col(name).isNull() | (F.lit(kinds != ("*",)) & ~F.col("type").isin(*kinds))).isEmpty():
            raise RuleError(f"{name} isn't defined for all of {selector}")
    for name in sorted(names & set(NODE_METRICS)):
        fill = F.lit(False) if name in ("dead", "in_cycle") else F.lit(0)
        subjects = subjects.join(NODE_METRICS[name](g).select("name", name), "name", "left").withColumn(name, F.coalesce(name, fill))
    test = compile_assertion(tree)
    if dict(subjects.select(test.alias("t")).dtypes)["t"] != "boolean":
        raise RuleError(f"not true or false: {assertion!r}")
    return subjects.where(~F.coalesce(test, F.lit(False))).select("name", *sorted(names - {"name"}))


def check(g: Graph, rule: Rule, groups: list[concepts.Concept] | None = None) -> DataFrame:
    """Witnesses of a rule's violation: rule, kind (edge, node, cycle, predicate), witness. No row: the rule holds."""
    if rule.type == "deny":
        found = check_deny(g, rule.pattern or "", rule.scope).select(F.lit("edge").alias("kind"), F.format_string("%s -[%s]-> %s", "source", "rel", "target").alias("witness"))
    elif rule.type == "quantified":
        found = check_quantified(g, rule.selector or "", rule.assertion or "", rule.scope).select(F.lit("predicate").alias("kind"), F.col("name").alias("witness"))
    elif rule.type == "invariant":
        whole = g if rule.invariant == "no-dead-code" or not rule.scope else Graph(g.nodes, g.relations)  # the others don't ask for containment
        sub = whole.scope(rule.scope) if rule.scope else whole
        if rule.invariant == "no-cycles":
            cycles = analytics.minimal_cycles(sub).groupBy("scc").agg(F.sort_array(F.collect_list(F.struct("step", "name"))).alias("s"))
            found = cycles.select(F.lit("cycle").alias("kind"), F.concat_ws(" -> ", F.col("s.name")).alias("witness"))
        elif rule.invariant == "no-dead-code":
            entries = None
            for pattern in filter(None, (p.strip() for p in rule.params.get("entry_points", "").split(","))):
                hit = sub.nodes.where(glob(F.col("name"), pattern)).select("name")
                entries = hit if entries is None else entries.union(hit)
            found = oo.dead_code(sub, entries).select(F.lit("node").alias("kind"), F.col("name").alias("witness"))
        elif rule.invariant == "no-layering-violations":
            found = analytics.cyclic_edges(sub).select(F.lit("edge").alias("kind"), F.format_string("%s -[%s]-> %s", "source", "rel", "target").alias("witness"))
        elif rule.invariant == "concept-boundaries":
            if not groups:
                raise RuleError("concept-boundaries needs a concept")
            found = concepts.crossings(sub, groups).where("not allowed").select(F.lit("edge").alias("kind"), F.format_string("%s -[%s]-> %s", "source", "rel", "target").alias("witness"))
        else:
            raise RuleError(f"unknown invariant: {rule.invariant!r}")
    else:
        raise RuleError(f"unknown type of rule: {rule.type!r}")
    return found.select(F.lit(rule.name).alias("rule"), "kind", "witness")


def check_all(g: Graph, rules: list[Rule], groups: list[concepts.Concept] | None = None) -> DataFrame:
    for rule in rules:  # before any is run
        validate_rule(rule)
    out = g.spark.createDataFrame([], "rule string, kind string, witness string")
    for rule in rules:
        out = out.union(check(g, rule, groups))
    return out


def _message() -> Column:
    return F.format_string("%s is violated by %d", "rule", "n")


def summary(g: Graph, rules: list[Rule], groups: list[concepts.Concept] | None = None) -> DataFrame:
    """(rule, type, message, witnesses) of each violated rule, with the number of its witnesses; none are collected."""
    rows = check_all(g, rules, groups).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("rule", _types(rules), _message().alias("message"), F.col("n").alias("witnesses"))


def _types(rules: list[Rule]) -> Column:
    names = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.type))) if rules else F.expr("map()").cast("map<string,string>")
    return F.element_at(names, F.col("rule")).alias("type")


def violations(g: Graph, rules: list[Rule], groups: list[concepts.Concept] | None = None) -> DataFrame:
    """One row per violated rule: rule, type, message, witnesses, and edges, nodes and cycles among them; those that it has none of are null."""
    found = check_all(g, rules, groups)
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("witness"))))
    some = lambda kind: F.when(F.size(of(kind)) > 0, of(kind))
    rows = found.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("kind", "witness"))).alias("witnesses"), some("edge").alias("edges"),
        F.coalesce(some("node"), some("predicate")).alias("nodes"), some("cycle").alias("cycles"),
    )
    return rows.select("rule", _types(rules), _message().alias("message"), "witnesses", "edges", "nodes", "cycles")
