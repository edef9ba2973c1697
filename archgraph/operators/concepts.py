"""Concepts: named groups of dotted prefixes, and the edges that cross their boundaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.model import Graph, under
from archgraph.store import cut


@dataclass(frozen=True)
class Concept:
    name: str
    prefixes: tuple[str, ...]
    sync_points: tuple[str, ...] = ()


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


#: Anchors, at most, that are told by a predicate each instead of a join.
ANCHORS = 64
_PREFIXES = "transform(sequence(1, size(split(name, '[.]'))), i -> array_join(slice(split(name, '[.]'), 1, i), '.'))"


def members(g: Graph, concepts: list[Concept]) -> DataFrame:
    """(name, concept): nodes below an anchor, the topmost packages and modules under a concept's prefixes.

    A node of two concepts is an error. Concepts are declarations, a handful: up to ANCHORS anchors, each is a predicate.
    """
    tops = _tops(g, concepts)
    named = _named(tops)
    if named is not None:
        return g.nodes.select("name", named(F.col("name")).alias("concept")).where("concept is not null")
    owned = g.nodes.select("name", F.explode(F.expr(_PREFIXES)).alias("anchor")).join(tops, "anchor").select("name", "concept")
    owned = cut(owned.distinct(), "members")
    twice = owned.groupBy("name").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]} belongs to several concepts")
    return owned


def _tops(g: Graph, concepts: list[Concept]) -> DataFrame:
    """(anchor, concept)."""
    found = g.spark.createDataFrame([], "anchor string, concept string")
    for c in concepts:
        anchors = g.nodes.where("type in ('package', 'module')").where(_any([under(F.col("name"), p) for p in c.prefixes])).select("name")
        # Topmost: no other anchor is a dotted prefix of it.
        nested = anchors.select("name", F.explode(F.expr(_PREFIXES)).alias("top")).where("top <> name").join(anchors.select(F.col("name").alias("top")), "top", "left_semi").select("name")
        found = found.union(anchors.join(nested, "name", "left_anti").select(F.col("name").alias("anchor"), F.lit(c.name).alias("concept")))
    return cut(found.distinct(), "anchors")


def _named(tops: DataFrame) -> Callable[[Column], Column] | None:
    """The concept of a node by its name alone, if there are few anchors. Anchors are nodes, so concepts overlap where anchors do."""
    few = [tuple(r) for r in tops.limit(ANCHORS + 1).collect()]
    if len(few) > ANCHORS:
        return None
    for a, c in few:
        for b, d in few:
            if c != d and (a == b or a.startswith(f"{b}.")):
                raise ValueError(f"{a} belongs to several concepts")
    by_name = lambda name, c: _any([under(name, a) for a, d in few if d == c])
    return lambda name: F.coalesce(F.lit(None).cast("string"), *(F.when(by_name(name, c), c) for c in sorted({c for _, c in few})))


def _touching(g: Graph, concepts: list[Concept], own: DataFrame | None = None) -> DataFrame:
    """All edges but containment with the concepts of both ends, where at least one has one.

    In a closed graph an end's concept is told by its name; else only ends that are nodes have one.
    """
    edges = g.relations.select("source", "rel", "target")
    if g.closed and (named := _named(_tops(g, concepts))):
        met = edges.select("*", named(F.col("source")).alias("a"), named(F.col("target")).alias("b"))
        return met.where("a is not null or b is not null")
    own = members(g, concepts) if own is None else own
    met = edges.join(own.select(F.col("name").alias("source"), F.col("concept").alias("a")), "source", "left").join(own.select(F.col("name").alias("target"), F.col("concept").alias("b")), "target", "left")
    return met.where("a is not null or b is not null")


def crossings(g: Graph, concepts: list[Concept]) -> DataFrame:
    """(source, rel, target, from_concept, to_concept, allowed): allowed if an end is a sync point of either concept."""
    syncs = [under(F.col(end), p) & (F.col(side) == c.name) for c in concepts for p in c.sync_points for end, side in (("source", "a"), ("target", "b"))]
    return _touching(g, concepts).where("a <> b").select("source", "rel", "target", F.col("a").alias("from_concept"), F.col("b").alias("to_concept"), _any(syncs).alias("allowed"))


def summary(g: Graph, concepts: list[Concept]) -> DataFrame:
    """Per concept: members, internal, cross_in, cross_out, sync_fan_out, sync_density, sync_asymmetry."""
    names = g.spark.createDataFrame([(c.name,) for c in concepts], "concept string")
    own = members(g, concepts)
    met = cut(_touching(g, concepts, own), "touching")
    sides = met.select(F.col("a").alias("concept"), F.when(F.col("a") == F.col("b"), "internal").when(F.col("b").isNotNull(), "out").alias("kind"), F.col("b").alias("other"))
    sides = sides.union(met.where("a is null or a <> b").select("b", F.when(F.col("a").isNotNull(), "in"), "a")).where("concept is not null and kind is not null")
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    counts = sides.groupBy("concept").agg(n("internal").alias("internal"), n("in").alias("cross_in"), n("out").alias("cross_out"), F.countDistinct(F.when(F.col("kind") == "out", F.col("other"))).alias("sync_fan_out"))
    pairs = met.where("a <> b").select("a", "b").distinct()
    ways = pairs.select(F.col("a").alias("concept"), F.col("b").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("b", "a", F.lit(0), F.lit(1)))
    partner = ways.groupBy("concept", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    shape = partner.groupBy("concept").agg(F.sum((F.col("o") + F.col("i") == 1).cast("long")).alias("uni"), F.sum((F.col("o") + F.col("i") == 2).cast("long")).alias("bi"))
    size = own.groupBy("concept").agg(F.count(F.lit(1)).alias("members"))
    out = names.join(size, "concept", "left").join(counts, "concept", "left").join(shape, "concept", "left").na.fill(0)
    crossing = F.col("cross_in") + F.col("cross_out")
    touched = F.col("internal") + crossing
    return out.select(
        "concept", "members", "internal", "cross_in", "cross_out", "sync_fan_out",
        F.bround(F.when(touched > 0, crossing / touched).otherwise(0.0), 6).alias("sync_density"), F.bround(F.col("uni") / F.greatest(F.lit(1).cast("long"), F.col("bi")), 6).alias("sync_asymmetry"),
    )


def dependencies(g: Graph, concepts: list[Concept]) -> DataFrame:
    """Per pair of concepts: edges and unsanctioned edges, with counts by relationship as text."""
    met = crossings(g, concepts)
    by_rel = met.groupBy("from_concept", "to_concept", "rel").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("allowed")).cast("long")).alias("bad"))
    return by_rel.groupBy("from_concept", "to_concept").agg(F.sum("n").alias("edges"), F.sum("bad").alias("unsanctioned"), F.array_join(F.sort_array(F.collect_list(F.format_string("%s:%d", "rel", "n"))), " ").alias("rels"))


def witnesses(g: Graph, concepts: list[Concept], most: int = 5) -> DataFrame:
    """The first `most` unsanctioned edges of each pair, a report."""
    bad = crossings(g, concepts).where("not allowed")
    return bad.selectExpr("*", "row_number() over (partition by from_concept, to_concept order by source, rel, target) as nth").where(F.col("nth") <= most).drop("allowed")


def candidates(g: Graph, concepts: list[Concept]) -> DataFrame:
    """(from_concept, to_concept, sync_point, edges): for each pair, by which inner ends its unsanctioned edges could be allowed."""
    bad = crossings(g, concepts).where("not allowed")
    ends = bad.select("from_concept", "to_concept", F.col("source").alias("sync_point")).union(bad.select("from_concept", "to_concept", "target"))
    return ends.groupBy("from_concept", "to_concept", "sync_point").agg(F.count(F.lit(1)).alias("edges"))


def allowed_syncs(g: Graph, concepts: list[Concept]) -> DataFrame:
    """(from_concept, to_concept, source, rel, target): the crossing edges that a sync point allows."""
    return crossings(g, concepts).where("allowed").select("from_concept", "to_concept", "source", "rel", "target")
