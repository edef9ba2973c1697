"""Object-oriented and package metrics, and code smells. All are joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.model import COUPLING, Graph
from archgraph.operators import kernels
from archgraph.operators.analytics import Arrays, components, small, weak_components
from archgraph.operators.select import is_entry_point
from archgraph.operators.traverse import ancestry
from archgraph.store import cut

GOD_CC, GOD_FUNCTIONS, GOD_FILES = 50, 15, 5
SHOTGUN = 7


def _classes(g: Graph) -> DataFrame:
    return g.nodes.where("type = 'class'").select(F.col("name").alias("class"))


def _members(g: Graph) -> DataFrame:
    """(class, member): what classes contain directly."""
    contains = g.edges.where("rel = 'contains'").select(F.col("source").alias("class"), F.col("target").alias("member")).distinct()
    return contains.join(_classes(g), "class", "left_semi")


def _methods(g: Graph) -> DataFrame:
    """(class, member, cc): functions and methods that classes contain directly; a missing complexity is 1."""
    code = g.nodes.where("type in ('function', 'method')").select(F.col("name").alias("member"), F.coalesce("cc", F.lit(1)).cast("long").alias("cc"))
    return _members(g).join(code, "member")


def _coupled(g: Graph) -> DataFrame:
    return g.edges.where(F.col("rel").isin(*COUPLING)).select("source", "rel", "target")


def wmc(g: Graph) -> DataFrame:
    """(class, wmc, max_method_cc, methods)."""
    sums = _methods(g).groupBy("class").agg(F.sum("cc").alias("wmc"), F.max("cc").alias("max_method_cc"), F.count(F.lit(1)).alias("methods"))
    return _classes(g).join(sums, "class", "left").na.fill(0)


def noc(g: Graph) -> DataFrame:
    """(class, noc): incoming inherits edges."""
    kids = g.edges.where("rel = 'inherits'").groupBy(F.col("target").alias("class")).agg(F.count(F.lit(1)).alias("noc"))
    return _classes(g).join(kids, "class", "left").na.fill(0)


def dit(g: Graph, distributed: bool = False) -> DataFrame:
    """(class, dit): longest inherits chain upward. Edges on an inheritance cycle don't count.

    A kernel does it up to its size. Beyond, roots are peeled level by level, so each level costs a
    join of what is left. A class on or below a cycle counts the chains that don't enter it.
    """
    up = cut(g.edges.where("rel = 'inherits' and source <> target").select("source", "target").distinct(), "inherits")
    if not distributed and small(up):
        x = Arrays(up)
        part = kernels.strong_components(x.n, x.a, x.b)
        apart = part[x.a] != part[x.b]  # without the edges inside strong components there is no cycle
        a, b = x.a[apart], x.b[apart]
        deep = kernels.layers(x.n, a, b, kernels.strong_components(x.n, a, b))
        return _classes(g).join(x.frame(g.spark, "class string, dit long", deep), "class", "left").na.fill(0)
    vertices = cut(up.select(F.col("source").alias("name")).union(up.select("target")).distinct(), "vertices")
    left, links, done, level = cut(vertices, "left"), up, None, 0
    while not left.isEmpty():
        ready = cut(left.join(links.select(F.col("source").alias("name")), "name", "left_anti").select("name", F.lit(level).cast("long").alias("dit")), "ready")
        if ready.isEmpty():
            # Only cycles and what hangs below them are left: without the edges inside strong components, anew.
            sub = Graph(g.nodes, links.select("source", F.lit("inherits").alias("rel"), "target"))
            scc = cut(components(sub), "components")
            joined = links.join(scc.withColumnRenamed("name", "source").withColumnRenamed("scc", "s"), "source").join(scc.withColumnRenamed("name", "target").withColumnRenamed("scc", "t"), "target")
            up = cut(up.join(joined.where("s = t").select("source", "target"), ["source", "target"], "left_anti"), "inherits")
            left, links, done, level = cut(vertices, "left"), up, None, 0
            continue
        done = ready if done is None else done.union(ready)
        left = cut(left.join(ready, "name", "left_anti"), "left")
        links = cut(links.join(ready.select(F.col("name").alias("target")), "target", "left_anti").select("source", "target"), "inherits")
        level += 1
    out = _classes(g)
    return out.join(done.withColumnRenamed("name", "class"), "class", "left").na.fill(0) if done is not None else out.withColumn("dit", F.lit(0).cast("long"))


def cbo(g: Graph) -> DataFrame:
    """(class, cbo): distinct other classes coupled, either way, with the class or a direct member.

    The other end counts as the class that contains it directly, or else as itself if a class.
    """
    own = _members(g).union(_classes(g).select("class", F.col("class").alias("member")))
    edges = _coupled(g).where("source <> target")
    ends = edges.select(F.col("source").alias("member"), F.col("target").alias("other")).union(edges.select("target", "source")).distinct()
    holder = _members(g).groupBy(F.col("member").alias("other")).agg(F.min("class").alias("holder"))
    classes = _classes(g).select(F.col("class").alias("other"), F.col("class").alias("itself"))
    met = own.join(ends, "member").join(holder, "other", "left").join(classes, "other", "left")
    met = met.withColumn("met", F.when(F.col("holder").isNotNull() & (F.col("holder") != F.col("class")), F.col("holder")).when(F.col("itself") != F.col("class"), F.col("itself")))
    counts = met.where("met is not null").select("class", "met").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("cbo"))
    return _classes(g).join(counts, "class", "left").na.fill(0)


def rfc(g: Graph) -> DataFrame:
    """(class, rfc): methods, plus distinct targets of their calls (own methods included)."""
    methods = _methods(g).select("class", "member")
    called = methods.join(g.edges.where("rel = 'calls'").select(F.col("source").alias("member"), "target"), "member").select("class", "target").distinct()
    both = methods.select("class", F.lit(1).alias("n")).union(called.select("class", F.lit(1))).groupBy("class").agg(F.sum("n").alias("rfc"))
    return _classes(g).join(both, "class", "left").na.fill(0)


def lcom4(g: Graph) -> DataFrame:
    """(class, lcom4): connected parts of the calls among a class's own methods."""
    methods = _methods(g).select("class", "member")
    calls = g.edges.where("rel = 'calls' and source <> target").select("source", "target")
    inside = calls.join(methods.select(F.col("member").alias("source"), F.col("class").alias("c1")), "source").join(methods.select(F.col("member").alias("target"), F.col("class").alias("c2")), "target")
    inside = cut(inside.where("c1 = c2").select("source", "target").distinct(), "inside")
    merged = methods
    if not inside.isEmpty():
        part = weak_components(inside).select(F.col("name").alias("member"), "component")
        merged = methods.join(part, "member", "left").select("class", F.coalesce("component", "member").alias("member"))
    counts = merged.distinct().groupBy("class").agg(F.count(F.lit(1)).alias("lcom4"))
    return _classes(g).join(counts, "class", "left").na.fill(0)


def _owners(g: Graph, tree: DataFrame) -> DataFrame:
    """(name, owner): of the packages and modules that contain a node, or are it, the last by name."""
    modules = g.nodes.where("type in ('package', 'module')").select(F.col("name").alias("ancestor"))
    return tree.join(modules, "ancestor").groupBy("name").agg(F.max("ancestor").alias("owner"))


def martin(g: Graph, tree: DataFrame | None = None, owner: DataFrame | None = None) -> DataFrame:
    """(module, ca, ce, instability, abstractness, distance) over all that a module or package contains.

    tree, owner: the ancestry and the owners, where they are known already.
    """
    tree = cut(ancestry(g), "ancestry") if tree is None else tree
    modules = g.nodes.where("type in ('package', 'module')").select(F.col("name").alias("module"))
    owner = cut(_owners(g, tree), "owners") if owner is None else owner
    inside = cut(tree.join(modules, F.col("ancestor") == F.col("module")).select("module", "name"), "inside")  # the module itself too
    links = g.links()

    def foreign(here: str, there: str, column: str) -> DataFrame:
        met = links.join(inside.withColumnRenamed("name", here), here).join(owner.withColumnRenamed("name", there), there)
        return met.where("owner <> module").select("module", "owner").distinct().groupBy("module").agg(F.count(F.lit(1)).alias(column))

    kinds = inside.join(g.nodes.select("name", "type"), "name").groupBy("module").agg(F.sum((F.col("type") == "class").cast("long")).alias("classes"), F.sum((F.col("type") == "interface").cast("long")).alias("interfaces"))
    all_ = modules.join(foreign("target", "source", "ca"), "module", "left").join(foreign("source", "target", "ce"), "module", "left").join(kinds, "module", "left").na.fill(0)
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    a = F.when(F.col("classes") + F.col("interfaces") > 0, F.col("interfaces") / (F.col("classes") + F.col("interfaces"))).otherwise(0.0)
    return all_.select("module", "ca", "ce", F.bround(i, 3).alias("instability"), F.bround(a, 3).alias("abstractness"), F.bround(F.abs(a + i - 1), 3).alias("distance"))


def sdp_violations(g: Graph) -> DataFrame:
    """(source, target, gap): modules that depend on others by over 0.1 less stable than they are."""
    tree = cut(ancestry(g), "ancestry")
    owner = cut(_owners(g, tree), "owners")
    metrics = cut(martin(g, tree, owner).select("module", "instability"), "martin")
    links = g.links().join(owner.select(F.col("name").alias("source"), F.col("owner").alias("a")), "source").join(owner.select(F.col("name").alias("target"), F.col("owner").alias("b")), "target")
    pairs = links.where("a <> b").select("a", "b").distinct()
    met = pairs.join(metrics.select(F.col("module").alias("a"), F.col("instability").alias("ia")), "a").join(metrics.select(F.col("module").alias("b"), F.col("instability").alias("ib")), "b")
    return met.where("ia < ib and bround(ib - ia, 9) > 0.1").select(F.col("a").alias("source"), F.col("b").alias("target"), F.bround(F.col("ib") - F.col("ia"), 3).alias("gap"))


def god_classes(g: Graph, least_wmc: int = 20, least_cbo: int = 5, least_lcom4: int = 2) -> DataFrame:
    big = wmc(g).where(F.col("wmc") >= least_wmc).select("class", "wmc")
    return big.join(cbo(g).where(F.col("cbo") >= least_cbo), "class").join(lcom4(g).where(F.col("lcom4") >= least_lcom4), "class")


def feature_envy(g: Graph) -> DataFrame:
    """(method, class, envied, own_refs, external_refs): methods that use another class at least twice and more than their own."""
    methods = _methods(g).select("class", F.col("member").alias("source"))
    owner = _members(g).select(F.col("member").alias("target"), F.col("class").alias("holder")).union(_classes(g).select("class", "class"))
    refs = methods.join(_coupled(g), "source").join(owner, "target")
    counts = refs.groupBy("source", "class", "holder").agg(F.count(F.lit(1)).alias("n"))
    own = counts.where("holder = class").select("source", F.col("n").alias("own"))
    best = counts.where("holder <> class").groupBy("source", "class").agg(F.max("n").alias("external_refs"), F.min_by("holder", F.struct(-F.col("n"), "holder")).alias("envied"))
    out = best.join(own, "source", "left").withColumn("own_refs", F.coalesce("own", F.lit(0).cast("long")))
    return out.where("external_refs > own_refs and external_refs >= 2").select(F.col("source").alias("method"), "class", "envied", "own_refs", "external_refs")


def shotgun_surgery(g: Graph, least: int = SHOTGUN) -> DataFrame:
    """(name, fan_out): functions and methods that couple to many."""
    code = g.nodes.where("type in ('function', 'method')").select("name")
    out = g.links().groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("fan_out")).where(F.col("fan_out") >= least)
    return out.join(code, "name", "left_semi")


def dead_code(g: Graph, entry_points: DataFrame | None = None) -> DataFrame:
    """(name, type): nodes nobody couples to or decorates, that are no entry point and whose container, if any, is dead too."""
    used = g.edges.where(F.col("rel").isin(*COUPLING, "decorates")).select(F.col("target").alias("name")).distinct()
    suspects = g.nodes.where("type not in ('package', 'module', 'endpoint', 'config')").where(~is_entry_point()).join(used, "name", "left_anti")
    if entry_points is not None:
        suspects = suspects.join(entry_points.select("name"), "name", "left_anti")
    suspects = suspects.select("name", "type")
    parent = g.contains().withColumnRenamed("child", "name")
    held = suspects.join(parent, "name", "left")
    alive = held.where("parent is not null").join(suspects.select(F.col("name").alias("parent")), "parent", "left_anti").select("name")
    return suspects.join(alive, "name", "left_anti")


def god_files(g: Graph) -> DataFrame:
    """(file, total_cc, max_cc, functions, classes, externals, reasons): files that hold too much."""
    code = F.col("type").isin("function", "method")
    cc = F.when(code, F.coalesce("cc", F.lit(1)).cast("long"))
    files = g.nodes.where("file is not null").groupBy("file").agg(
        F.coalesce(F.sum(cc), F.lit(0).cast("long")).alias("total_cc"), F.coalesce(F.max(cc), F.lit(0).cast("long")).alias("max_cc"),
        F.sum(code.cast("long")).alias("functions"), F.sum((F.col("type") == "class").cast("long")).alias("classes"),
    )
    where = g.nodes.where("file is not null").select("name", "file")
    met = g.links().join(where.select(F.col("name").alias("source"), "file"), "source").join(where.select(F.col("name").alias("target"), F.col("file").alias("other")), "target")
    outside = met.where("file <> other").select("file", "other").distinct().groupBy("file").agg(F.count(F.lit(1)).alias("externals"))
    all_ = files.join(outside, "file", "left").na.fill(0, ["externals"])
    reasons = F.concat_ws(
        ", ", F.when(F.col("total_cc") >= GOD_CC, F.format_string("complexity %d", "total_cc")), F.when(F.col("functions") >= GOD_FUNCTIONS, F.format_string("%d functions", "functions")),
        F.when((F.col("externals") >= GOD_FILES) & (F.col("total_cc") >= GOD_CC), F.format_string("%d files used", "externals")),
    )
    return all_.withColumn("reasons", reasons).where("reasons <> ''")
