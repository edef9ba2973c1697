"""Reachability, shortest paths, neighborhoods and containment.

Closures are frontier loops: each level joins the edges with the newest names only and drops
what was seen. Up to LOCAL names those are kept on the driver, and a level is one scan; beyond, they
are tables, and a level costs a shuffle of its own size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.model import COUPLING, Graph, coupling
from archgraph.store import cut

#: Names, at most, that a closure keeps on the driver, and levels of containment that are met one by one.
LOCAL, LEVELS = 100_000, 8


def _hops(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there) along edges, against them, or both."""
    ahead = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"))
    return {"out": ahead, "in": back, "both": ahead.union(back)}[direction]


def levels(edges: DataFrame, starts: DataFrame, direction: str = "out", max_depth: int | None = None, until: str | None = None) -> DataFrame:
    """(name, depth) of all that is reachable from starts.name, the starts at depth 0."""
    hops = cut(_hops(edges, direction), "hops")
    spark, schema, depth = hops.sparkSession, "name string, depth int", 0
    first = starts.select("name").distinct().limit(LOCAL + 1).collect()
    if len(first) <= LOCAL:
        known = {r[0]: 0 for r in first}
        newest = list(known)
        while newest and (max_depth is None or depth < max_depth):
            here = F.broadcast(spark.createDataFrame([(name,) for name in newest], "here string"))
            met = hops.join(here, "here").select("there").distinct().limit(LOCAL + 1).collect()
            if len(met) + len(known) > LOCAL:
                break
            depth += 1
            newest = [r[0] for r in met if r[0] not in known]
            known |= dict.fromkeys(newest, depth)
            if until is not None and until in newest:
                newest = []
        else:
            return spark.createDataFrame(list(known.items()), schema)
        seen = cut(spark.createDataFrame(list(known.items()), schema), "level")
        frontier = seen.where(F.col("depth") == depth)
    else:
        frontier = seen = cut(starts.select("name", F.lit(0).alias("depth")).distinct(), "level")
    while max_depth is None or depth < max_depth:
        depth += 1
        new = hops.join(frontier.select(F.col("name").alias("here")), "here").select(F.col("there").alias("name")).distinct()
        frontier = cut(new.join(seen.select("name"), "name", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if until is not None and not frontier.where(F.col("name") == until).isEmpty():
            break
    return seen


def closure(g: Graph, name: str, rels: tuple[str, ...] | None, direction: str, max_depth: int | None = None) -> DataFrame:
    """(name, depth) of what is reached from one node, which is left out."""
    edges = g.edges.where(F.col("rel").isin(*rels)) if rels else g.edges
    start = g.nodes.where(F.col("name") == name).select("name")
    return levels(edges, start, direction, max_depth).where("depth > 0")


def transitive_deps(g: Graph, name: str, rels: tuple[str, ...] = ("depends_on", "imports"), max_depth: int | None = None) -> DataFrame:
    return closure(g, name, rels, "out", max_depth)


def transitive_callers(g: Graph, name: str, max_depth: int | None = None) -> DataFrame:
    return closure(g, name, ("calls",), "in", max_depth)


def ancestors(g: Graph, name: str, rel: str = "contains", max_depth: int | None = None) -> DataFrame:
    return closure(g, name, (rel,), "in", max_depth)


def descendants(g: Graph, name: str, rel: str = "contains", max_depth: int | None = None) -> DataFrame:
    return closure(g, name, (rel,), "out", max_depth)


def impact(g: Graph, name: str, rels: tuple[str, ...] | None = COUPLING, max_depth: int | None = None) -> DataFrame:
    return closure(g, name, rels, "in", max_depth)


def shortest_path(g: Graph, source: str, target: str) -> DataFrame:
    """(step, name) along a shortest path over all edges, ignoring direction; empty if there is none.

    Of equally short paths, the one that from the target back takes the least name at each step.
    """
    spark = g.spark
    known = {r[0] for r in g.nodes.where(F.col("name").isin(source, target)).select("name").collect()}
    if {source, target} - known:
        return spark.createDataFrame([], "step int, name string")
    if source == target:
        return spark.createDataFrame([(0, source)], "step int, name string")
    # Both ends search, that with the smaller frontier first.
    hops = cut(_hops(g.edges, "both"), "hops")
    sides = [{"seen": (f := cut(spark.createDataFrame([(n,)], "name string"), "level")), "levels": [f], "size": 1} for n in (source, target)]
    while True:
        here, other = sorted((0, 1), key=lambda k: sides[k]["size"])
        side = sides[here]
        met = hops.join(side["levels"][-1].select(F.col("name").alias("here")), "here").select(F.col("there").alias("name")).distinct()
        new = cut(met.join(side["seen"], "name", "left_anti"), "level")
        side["size"] = new.count()
        if not side["size"]:
            return spark.createDataFrame([], "step int, name string")
        side["levels"].append(new)
        side["seen"] = side["seen"].union(new)
        if not new.join(sides[other]["levels"][-1], "name", "left_semi").isEmpty():
            break
    # The definition goes back from the target by least names among nodes at the right distance of the
    # source, so what the target's side has found is walked first, kept to nodes that lie on shortest paths.
    ahead, behind = (s["levels"] for s in sides)
    kept = [cut(ahead[-1].join(behind[-1], "name", "left_semi"), "meeting")]  # from the meeting towards the target
    for level in reversed(behind[:-1]):
        step = hops.join(kept[-1].select(F.col("name").alias("here")), "here").select(F.col("there").alias("name")).distinct()
        kept.append(cut(level.join(step, "name", "left_semi"), "on-path"))
    path = [target]
    for level in [*reversed(kept[:-1]), *reversed(ahead[:-1])]:
        back = hops.where(F.col("there") == path[-1]).select(F.col("here").alias("name"))
        path.append(back.join(level, "name", "left_semi").agg(F.min("name")).collect()[0][0])
    return spark.createDataFrame(list(enumerate(reversed(path))), "step int, name string")


def between(g: Graph, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """A shortest path, and the direct edges in both directions."""
    direct = g.edges.where(((F.col("source") == a) & (F.col("target") == b)) | ((F.col("source") == b) & (F.col("target") == a)))
    return shortest_path(g, a, b), direct.select("source", "rel", "target")


def subgraph(g: Graph, name: str, depth: int = 2, direction: str = "both", rels: tuple[str, ...] | None = None, most: int | None = None) -> Graph:
    """What lies within depth hops, and the edges (of the same relationships) among it. `most`: a picture of so many nodes, those with the most edges after the start."""
    edges = g.edges.where(F.col("rel").isin(*rels)) if rels else g.edges
    near = levels(edges, g.nodes.where(F.col("name") == name).select("name"), direction, depth).select("name")
    if most is not None:
        ends = edges.select(F.col("source").alias("name")).union(edges.select("target")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
        near = near.join(ends, "name", "left").orderBy(F.col("name") != name, F.desc_nulls_last("degree"), "name").limit(most).select("name")
    inside = edges.join(near.withColumnRenamed("name", "source"), "source", "left_semi").join(near.withColumnRenamed("name", "target"), "target", "left_semi") if depth else edges.where("false")
    return Graph(g.nodes.join(near, "name", "left_semi"), inside.select(*g.edges.columns))


def containment_path(g: Graph, name: str) -> DataFrame:
    """(depth, name): from the node at 0 up to its root. Stops at a repeated node."""
    parents = g.contains()
    path = [name]
    while True:
        up = parents.where(F.col("child") == path[-1]).select("parent").collect()
        if not up or up[0][0] in path:
            break
        path.append(up[0][0])
    return g.spark.createDataFrame(list(enumerate(path)), "depth int, name string")


def ancestry(g: Graph, parents: DataFrame | None = None) -> DataFrame:
    """(name, ancestor, depth) over containment, each node its own ancestor at depth 0.

    Path doubling: after k rounds all ancestors up to 2**k levels are known. It ends when no pair is
    new, so cycles of containment end it too.
    """
    up = cut((parents or g.containment.select(F.col("target").alias("child"), F.col("source").alias("parent")).distinct()), "parents")
    known = cut(up.select(F.col("child").alias("name"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "ancestry")
    reach = 1
    while True:
        further = known.join(known.select(F.col("name").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("depth").alias("more")), "ancestor").where(F.col("depth") == reach)
        further = further.select("name", F.col("beyond").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).where("name <> ancestor")
        new = cut(further.groupBy("name", "ancestor").agg(F.min("depth").alias("depth")).join(known.select("name", "ancestor"), ["name", "ancestor"], "left_anti"), "ancestry")
        if new.isEmpty():
            break
        known = known.union(new)
        reach *= 2
    known = known.groupBy("name", "ancestor").agg(F.min("depth").alias("depth"))
    return g.nodes.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("depth")).union(known)


def module_members(g: Graph) -> DataFrame:
    """(module, name): all that a package or module contains, at any depth."""
    modules = g.nodes.where("type in ('package', 'module')").select(F.col("name").alias("module"))
    return ancestry(g).where("depth > 0").join(modules, F.col("ancestor") == F.col("module")).select("module", "name")


def containing(g: Graph, types: tuple[str, ...] = ("module", "package")) -> DataFrame:
    """(name, owner): the nearest node of these types that contains a node; a node of the type is its own.

    Owners are handed down: each of up to LEVELS rounds joins the edges with the newest owned containers only,
    so that what contains nothing is met once. What lies deeper takes the ancestry of what is left.
    """
    up = g.containment.select(F.col("source").alias("parent"), F.col("target").alias("name"))
    inner = cut(up.select(F.col("parent").alias("name")).distinct(), "containers").withColumn("inner", F.lit(True))
    own = g.nodes.where(F.col("type").isin(*types)).select("name", F.col("name").alias("owner"))
    known = cut(own.join(inner, "name", "left").select("name", "owner", F.lit(0).alias("depth"), F.coalesce("inner", F.lit(False)).alias("inner")), "owners")
    newest = known
    for depth in range(1, LEVELS + 1):
        newest = newest.where("inner").select(F.col("name").alias("parent"), "owner")
        if newest.isEmpty():
            return known.select("name", "owner")
        met = up.join(newest, "parent").groupBy("name").agg(F.min("owner").alias("owner")).join(known.select("name"), "name", "left_anti")
        newest = cut(met.join(inner, "name", "left").select("name", "owner", F.lit(depth).alias("depth"), F.coalesce("inner", F.lit(False)).alias("inner")), "owners")
        known = known.union(newest)
    left = up.join(known.select("name"), "name", "left_anti").select(F.col("name").alias("child"), "parent").distinct()
    above = ancestry(g, left).where("depth > 0").join(known.select(F.col("name").alias("ancestor"), "owner", F.col("depth").alias("more")), "ancestor")
    return known.select("name", "owner").union(above.groupBy("name").agg(F.min_by("owner", F.struct(F.col("depth") + F.col("more"), F.col("owner"))).alias("owner")))


def module_ranking(g: Graph) -> DataFrame:
    """(module, incoming, outgoing): coupling edges that enter and leave each module, by the nearest module of their ends."""
    own = cut(containing(g, ("module",)), "owners")
    met = g.links().join(own.select(F.col("name").alias("source"), F.col("owner").alias("a")), "source").join(own.select(F.col("name").alias("target"), F.col("owner").alias("b")), "target").where("a <> b")
    ends = met.select(F.col("a").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(met.select("b", F.lit(1), F.lit(0)))
    return ends.groupBy("module").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def card(g: Graph, name: str, shown: int = 10) -> DataFrame:
    """(section, position, text, hidden) about a node: its path of containment, rings by distance, and edges by direction and relationship.

    Of edges the first `shown` are listed, and how many are hidden.
    """
    path = containment_path(g, name).select(F.lit("path").alias("section"), F.col("depth").alias("position"), F.col("name").alias("text"), F.lit(0).cast("long").alias("hidden"))
    coupled = g.edges.where(coupling())
    rings = levels(coupled, g.nodes.where(F.col("name") == name).select("name"), "both", 3).where("depth > 0").groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    rings = rings.select(F.lit("ring"), F.col("depth"), F.format_string("%d nodes", "n"), F.lit(0).cast("long"))
    ahead = g.edges.where(F.col("source") == name).select(F.concat(F.lit("out "), "rel").alias("section"), F.col("target").alias("text"))
    edges = ahead.union(g.edges.where(F.col("target") == name).select(F.concat(F.lit("in "), "rel"), "source"))
    ranked = edges.selectExpr("section", "cast(row_number() over (partition by section order by text) as int) as position", "text", "count(*) over (partition by section) as n")
    listed = ranked.where(F.col("position") <= shown).select("section", "position", "text", F.greatest(F.col("n") - shown, F.lit(0)).alias("hidden"))
    return path.union(rings).union(listed)
