"""Graph analytics on the coupling graph: components, layers, ranks, cores, centrality, bridges.

Each operator counts the edges first. Up to KERNEL_EDGES they go to a kernel on the driver as
two integer arrays (16 bytes an edge). Up to TASK_EDGES names are numbered by joins, and one task of
an executor takes the numbers (8 bytes an edge, and at most some 40 while it sorts them); only its
result, as numbers, is joined with the names again. Beyond, the same result is reached by supersteps
of joins and aggregations, whose lineage is cut into written tables.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.model import Graph, coupling
from archgraph.operators import kernels
from archgraph.store import arm, cut

#: Edges, at most, that a kernel on the driver takes, and one in a task.
KERNEL_EDGES, TASK_EDGES = 2_000_000, 64_000_000
BETWEENNESS_NODES, BETWEENNESS_SAMPLED, BETWEENNESS_SAMPLE = 50_000, 5_000, 500


class Arrays:
    """A bounded edge list as integers; vertices are numbered in the order of their names."""

    def __init__(self, links: DataFrame):
        table = links.select("source", "target").toArrow()
        both = pa.chunked_array([*table.column("source").chunks, *table.column("target").chunks], pa.string()).combine_chunks().dictionary_encode()
        # Arrow strings and integers all the way; only the distinct names become Python strings.
        order = pa.compute.sort_indices(both.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.names = np.array(both.dictionary.take(pa.array(order)).to_pylist(), object) if len(order) else np.zeros(0, object)
        code = place[both.indices.to_numpy(zero_copy_only=False)] if len(both) else np.zeros(0, np.int64)
        m = table.num_rows
        self.a, self.b, self.n = code[:m], code[m:], len(self.names)

    def undirected(self, loops: bool = True) -> tuple[np.ndarray, np.ndarray]:
        keep = slice(None) if loops else self.a != self.b
        pairs = np.unique(np.stack([np.concatenate([self.a[keep], self.b[keep]]), np.concatenate([self.b[keep], self.a[keep]])]), axis=1)
        return pairs[0], pairs[1]

    def frame(self, spark: SparkSession, schema: str, *columns: np.ndarray) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        return spark.createDataFrame(pa.table([pa.array(self.names.tolist(), pa.string()), *(pa.array(c) for c in columns)], names=names)) if self.n else spark.createDataFrame([], schema)


def small(links: DataFrame) -> bool:
    return links.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES


def _vertices(links: DataFrame) -> DataFrame:
    return links.select(F.col("source").alias("name")).union(links.select("target")).distinct()


class Coded:
    """An edge list as numbers in tables. Vertices are numbered in the order of their names."""

    def __init__(self, links: DataFrame):
        self.spark = links.sparkSession
        sorted_ = cut(_vertices(links).orderBy("name").withColumn("at", F.monotonically_increasing_id()), "vertices")
        sizes = dict(sorted_.groupBy(F.shiftright("at", 33).cast("int").alias("part")).count().collect())
        starts, self.n = [], 0
        for part in range(max(sizes, default=0) + 1):
            starts.append(self.n)
            self.n += sizes.get(part, 0)
        start = F.element_at(F.array(*(F.lit(x).cast("long") for x in starts)), F.shiftright("at", 33).cast("int") + 1)
        self.names = sorted_.select("name", (start + F.col("at").bitwiseAND(2**33 - 1)).cast("int").alias("id"))
        ends = self.names.hint("merge")
        coded = links.join(ends.select(F.col("name").alias("source"), F.col("id").alias("a")), "source").join(ends.select(F.col("name").alias("target"), F.col("id").alias("b")), "target")
        self.links = cut(coded.select("a", "b"), "coded")

    def run(self, kernel: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
        """What a kernel makes of all edges, in one task."""
        arm(self.spark)
        n, names = self.n, [x.split()[0] for x in schema.split(", ")]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
            a, b = (np.concatenate([e[i] for e in ends]) if ends else np.zeros(0, np.int32) for i in (0, 1))
            del ends
            columns = kernel(n, a, b)
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in columns], names=names)

        return cut(self.links.coalesce(1).mapInArrow(task, schema), "kernel")

    def frame(self, kernel: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
        """As run, where the columns have a value for each vertex: with its name instead of its number."""
        found = self.run(lambda n, a, b: (np.arange(n, dtype=np.int32), *kernel(n, a, b)), f"id int, {schema}")
        return self.names.join(found.hint("merge"), "id").drop("id")

    def name(self, df: DataFrame, column: str) -> DataFrame:
        """A column of numbers as names."""
        ends = self.names.select(F.col("id").alias(column), F.col("name").alias(f"__{column}")).hint("merge")
        return df.join(ends, column).drop(column).withColumnRenamed(f"__{column}", column)


class _Links:
    """The coupling graph's edges, written, and numbered when first asked for."""

    def __init__(self, g: Graph):
        self.table = cut(g.links(), "links")
        self.count = self.table.count()
        self.coded: Coded | None = None

    def code(self) -> Coded:
        self.coded = self.coded or Coded(self.table)
        return self.coded


_LINKS: weakref.WeakKeyDictionary[DataFrame, _Links] = weakref.WeakKeyDictionary()


def _links(g: Graph) -> _Links:
    """Written and numbered once for a graph, whatever operators use it."""
    edges = g.edges
    if edges not in _LINKS:
        _LINKS[edges] = _Links(g)
    return _LINKS[edges]


def _either(g: Graph, kernel: Callable[[Arrays], DataFrame], task: Callable[[Coded], DataFrame], steps: Callable[[DataFrame], DataFrame], distributed: bool) -> DataFrame:
    links = _links(g)
    if distributed or links.count > TASK_EDGES:
        return steps(links.table)
    return kernel(Arrays(links.table)) if links.count <= KERNEL_EDGES else task(links.code())


# Strong components


def components(g: Graph, distributed: bool = False) -> DataFrame:
    """(name, scc): strong components of the coupling graph, named by their least member."""

    def kernel(x: Arrays) -> DataFrame:
        part = kernels.strong_components(x.n, x.a, x.b)
        least = np.full(x.n, x.n)
        np.minimum.at(least, part, np.arange(x.n))
        return x.frame(g.spark, "name string, scc string", np.array(x.names[least[part]].tolist(), object) if x.n else np.zeros(0, object))

    def task(x: Coded) -> DataFrame:
        return x.name(x.frame(lambda n, a, b: (kernels.least_components(n, a, b),), "scc int"), "scc").select("name", "scc")

    return _either(g, kernel, task, _colored, distributed)


def _trim(links: DataFrame) -> DataFrame:
    """Drops edges at vertices that lack a way in or out, until none does: such are on no cycle."""
    links = links.where("source <> target")
    n = links.count()
    while n:
        ins = links.select(F.col("target").alias("source")).distinct()
        outs = links.select(F.col("source").alias("target")).distinct()
        links = cut(links.join(ins, "source", "left_semi").join(outs, "target", "left_semi").select("source", "target"), "trim")
        m = links.count()
        if m == n:
            break
        n = m
    return links


def _spread(links: DataFrame, colors: DataFrame) -> DataFrame:
    """The least color that reaches each vertex."""
    while True:
        met = links.join(colors, links.source == colors.name).groupBy(F.col("target").alias("v")).agg(F.min("color").alias("via"))
        new = cut(colors.join(met, colors.name == met.v, "left").select("name", F.col("color").alias("was"), F.least("color", "via").alias("color")), "color")
        colors = new.select("name", "color")
        if new.where("was <> color").isEmpty():
            return colors


def _colored(links: DataFrame) -> DataFrame:
    """Trimming, then rounds of coloring: of those of one color, what reaches its origin backwards is a component."""
    everything = _vertices(links)
    left, found = _trim(links), None
    while not left.isEmpty():
        vertices = cut(_vertices(left), "vertices")
        colors = _spread(left, vertices.withColumn("color", F.col("name")))
        same = left.join(colors.withColumnRenamed("name", "source").withColumnRenamed("color", "c1"), "source").join(colors.withColumnRenamed("name", "target").withColumnRenamed("color", "c2"), "target").where("c1 = c2")
        same = cut(same.select(F.col("target").alias("source"), F.col("source").alias("target")), "same")
        marked = cut(colors.where("name = color"), "marked")
        frontier = marked
        while not frontier.isEmpty():
            new = same.join(frontier.withColumnRenamed("name", "source"), "source").select(F.col("target").alias("name"), "color").distinct()
            frontier = cut(new.join(marked.select("name"), "name", "left_anti"), "marked")
            marked = marked.union(frontier)
        found = marked if found is None else found.union(marked)
        rest = left.join(marked.select(F.col("name").alias("source")), "source", "left_anti").join(marked.select(F.col("name").alias("target")), "target", "left_anti")
        left = _trim(cut(rest.select("source", "target"), "left"))
    if found is None:
        return everything.select("name", F.col("name").alias("scc"))
    least = found.groupBy("color").agg(F.min("name").alias("scc"))
    named = found.join(least, "color").select("name", "scc")
    return everything.join(named, "name", "left").select("name", F.coalesce("scc", "name").alias("scc"))


def find_cycles(g: Graph, distributed: bool = False) -> DataFrame:
    """(scc, name) of strong components with more than one member. Kernels give only these."""

    def several(least: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(least, minlength=len(least))[least] > 1)

    def kernel(x: Arrays) -> DataFrame:
        part = kernels.strong_components(x.n, x.a, x.b)
        least = np.full(x.n, x.n)
        np.minimum.at(least, part, np.arange(x.n))
        here = several(least[part])
        if not len(here):
            return g.spark.createDataFrame([], "scc string, name string")
        return g.spark.createDataFrame(pa.table({"scc": pa.array(x.names[least[part[here]]].tolist(), pa.string()), "name": pa.array(x.names[here].tolist(), pa.string())}))

    def task(x: Coded) -> DataFrame:
        def members(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
            least = kernels.least_components(n, a, b)
            here = several(least)
            return least[here].astype(np.int32), here.astype(np.int32)

        return x.name(x.name(x.run(members, "scc int, name int"), "scc"), "name").select("scc", "name")

    def steps(links: DataFrame) -> DataFrame:
        parts = cut(_colored(links), "components")
        return parts.join(parts.groupBy("scc").count().where("count > 1").select("scc"), "scc").select("scc", "name")

    return _either(g, kernel, task, steps, distributed)


def minimal_cycles(g: Graph) -> DataFrame:
    """(scc, step, name): a shortest cycle of each strong component with several members."""
    arm(g.spark)
    inside = find_cycles(g)
    links = _links(g).table.join(inside.select("scc", F.col("name").alias("source")), "source").join(inside.select(F.col("scc").alias("scc2"), F.col("name").alias("target")), "target").where("scc = scc2")
    links = cut(links.select("scc", "source", "target"), "cycle-links")
    if links.groupBy("scc").count().where(F.col("count") > KERNEL_EDGES).isEmpty():

        def shortest(rows):
            names = sorted({*rows["source"], *rows["target"]})
            at = {v: i for i, v in enumerate(names)}
            cycle = kernels.least_cycle(len(names), rows["source"].map(at).to_numpy(), rows["target"].map(at).to_numpy())
            return rows.iloc[: len(cycle)][["scc"]].assign(step=range(len(cycle)), name=[names[i] for i in cycle])

        return links.groupBy("scc").applyInPandas(shortest, "scc string, step int, name string")
    raise ValueError(f"a component has more than {KERNEL_EDGES} edges; list its members with find_cycles")


# Layers


def layers(g: Graph, distributed: bool = False) -> DataFrame:
    """(name, layer): 0 where no coupling leaves the strong component, else one more than the highest target."""

    def kernel(x: Arrays) -> DataFrame:
        return x.frame(g.spark, "name string, layer long", kernels.layers(x.n, x.a, x.b, kernels.strong_components(x.n, x.a, x.b)))

    def task(x: Coded) -> DataFrame:
        return x.frame(lambda n, a, b: (kernels.levels_above(n, a, b, kernels.least_components(n, a, b)),), "layer long")

    def steps(links: DataFrame) -> DataFrame:
        parts = cut(_colored(links), "components")
        dag = links.join(parts.withColumnRenamed("name", "source").withColumnRenamed("scc", "s"), "source").join(parts.withColumnRenamed("name", "target").withColumnRenamed("scc", "t"), "target")
        dag = cut(dag.where("s <> t").select("s", "t").distinct(), "dag")
        done, level = None, 0
        left = cut(parts.select("scc").distinct(), "left")
        while not left.isEmpty():
            sinks = cut(left.join(dag.select(F.col("s").alias("scc")), "scc", "left_anti").withColumn("layer", F.lit(level).cast("long")), "sinks")
            done = sinks if done is None else done.union(sinks)
            left = cut(left.join(sinks, "scc", "left_anti"), "left")
            dag = cut(dag.join(sinks.select(F.col("scc").alias("t")), "t", "left_anti").select("s", "t"), "dag")
            level += 1
        return parts.join(done, "scc").select("name", "layer") if done is not None else parts.selectExpr("name", "0L as layer")

    return _either(g, kernel, task, steps, distributed)


def layering_violations(g: Graph) -> DataFrame:
    """Coupling edges that don't descend: exactly those inside a strong component."""
    at = find_cycles(g).join(cut(layers(g), "layers"), "name")
    return _inside(g, at).selectExpr("source", "rel", "target", "s.layer as source_layer", "t.layer as target_layer")


def cyclic_edges(g: Graph) -> DataFrame:
    """(source, rel, target) of the coupling edges that don't descend, without their layers."""
    return _inside(g, find_cycles(g)).select("source", "rel", "target")


def _inside(g: Graph, members: DataFrame) -> DataFrame:
    """Coupling edges between different members of a strong component; s and t hold what is known of their ends."""
    at = cut(members, "cycles")  # only components of several members have edges inside
    known = F.struct(*(c for c in at.columns if c != "name"))
    edges = g.relations.where(coupling() & (F.col("source") != F.col("target"))).select("source", "rel", "target")
    met = edges.join(at.select(F.col("name").alias("source"), known.alias("s")), "source").join(at.select(F.col("name").alias("target"), known.alias("t")), "target")
    return met.where("s.scc = t.scc")


# Ranks


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 50, distributed: bool = False) -> DataFrame:
    """(name, pagerank) after exactly `rounds` rounds; what dangling nodes hold is spread evenly."""

    def kernel(x: Arrays) -> DataFrame:
        return x.frame(g.spark, "name string, pagerank double", kernels.pagerank(x.n, x.a, x.b, damping, rounds))

    def task(x: Coded) -> DataFrame:
        return x.frame(lambda n, a, b: (kernels.pagerank_large(n, a, b, damping, rounds),), "pagerank double")

    def steps(links: DataFrame) -> DataFrame:
        degree = links.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
        vertices = cut(_vertices(links), "vertices")
        n = vertices.count()
        state = cut(vertices.join(degree, vertices.name == degree.source, "left").select("name", "degree", F.lit(1 / max(n, 1)).alias("rank")), "rank")
        for _ in range(rounds):
            lost = state.where("degree is null").agg(F.sum("rank")).collect()[0][0] or 0.0
            got = links.join(state.select(F.col("name").alias("source"), (F.col("rank") / F.col("degree")).alias("share")), "source").groupBy(F.col("target").alias("v")).agg(F.sum("share").alias("got"))
            state = cut(state.join(got, state.name == got.v, "left").select("name", "degree", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank")), "rank")
        return state.select("name", F.col("rank").alias("pagerank"))

    return _either(g, kernel, task, steps, distributed)


def hits(g: Graph, rounds: int = 50, distributed: bool = False) -> DataFrame:
    """(name, hub, authority), normalized to length 1 and rounded to six digits."""

    def kernel(x: Arrays) -> DataFrame:
        hub, authority = kernels.hits(x.n, x.a, x.b, rounds)
        return x.frame(g.spark, "name string, hub double, authority double", hub, authority)

    def task(x: Coded) -> DataFrame:
        return x.frame(lambda n, a, b: kernels.hits_large(n, a, b, rounds), "hub double, authority double")

    def steps(links: DataFrame) -> DataFrame:
        vertices = cut(_vertices(links), "vertices")
        hub = vertices.withColumn("hub", F.lit(1.0))
        authority = vertices.withColumn("authority", F.lit(1.0))
        norm = lambda df, c: max(float(np.sqrt(df.agg(F.sum(F.col(c) * F.col(c))).collect()[0][0] or 0.0)), 1e-10)
        for _ in range(rounds):
            raw = cut(vertices.join(links.join(hub.withColumnRenamed("name", "source"), "source").groupBy(F.col("target").alias("name")).agg(F.sum("hub").alias("authority")), "name", "left").na.fill(0.0), "authority")
            new = cut(vertices.join(links.join(raw.withColumnRenamed("name", "target"), "target").groupBy(F.col("source").alias("name")).agg(F.sum("authority").alias("hub")), "name", "left").na.fill(0.0), "hub")
            authority = raw.withColumn("authority", F.col("authority") / norm(raw, "authority"))
            hub = new.withColumn("hub", F.col("hub") / norm(new, "hub"))
        return hub.join(authority, "name")

    found = _either(g, kernel, task, steps, distributed)
    return found.select("name", F.bround("hub", 6).alias("hub"), F.bround("authority", 6).alias("authority"))


def fan_in_out(g: Graph) -> DataFrame:
    """(name, fan_in, fan_out): distinct coupling sources and targets of nodes that have a coupling edge."""
    ends = g.links().select(F.col("source").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(g.links().select("target", F.lit(1), F.lit(0)))
    return ends.groupBy("name").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


# Undirected structure


def kcore(g: Graph, distributed: bool = False) -> DataFrame:
    """(name, core): the largest k such that a node is in a k-core of the undirected coupling graph."""

    def kernel(x: Arrays) -> DataFrame:
        return x.frame(g.spark, "name string, core long", kernels.coreness(x.n, *x.undirected()))

    def task(x: Coded) -> DataFrame:
        return x.frame(lambda n, a, b: (kernels.cores(n, a, b),), "core long")

    def steps(links: DataFrame) -> DataFrame:
        """Each node's estimate falls to the h-index of its neighbors' until nothing changes."""
        both = cut(links.select("source", "target").union(links.select("target", "source")).distinct(), "both")
        state = cut(both.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("core")), "core")
        while True:
            # The h-index by counting: for each value v, how many neighbors have at least v.
            seen = both.join(state.select(F.col("name").alias("target"), "core"), "target").groupBy(F.col("source").alias("name"), "core").agg(F.count(F.lit(1)).alias("n"))
            upto = seen.selectExpr("name", "core", "sum(n) over (partition by name order by core desc) as above")
            h = upto.groupBy("name").agg(F.max(F.least("core", "above")).alias("h"))
            new = cut(state.join(h, "name").select("name", F.col("core").alias("was"), F.least("core", "h").alias("core")), "core")
            state = new.select("name", "core")
            if new.where("was <> core").isEmpty():
                return state

    return _either(g, kernel, task, steps, distributed)


def weak_components(links: DataFrame) -> DataFrame:
    """(name, component): least name reachable ignoring direction; minima travel along edges and by pointer jumping."""
    both = cut(links.select("source", "target").union(links.select("target", "source")).distinct(), "both")
    state = cut(both.groupBy(F.col("source").alias("name")).agg(F.least(F.min("target"), F.first("source")).alias("component")), "weak")
    while True:
        met = both.join(state.withColumnRenamed("name", "target"), "target").groupBy(F.col("source").alias("v")).agg(F.min("component").alias("via"))
        near = state.join(met, state.name == met.v).select("name", F.col("component").alias("was"), F.least("component", "via").alias("via"))
        jump = state.select(F.col("name").alias("via"), F.col("component").alias("beyond"))
        new = cut(near.join(jump, "via").select("name", "was", F.least("via", "beyond").alias("component")), "weak")
        state = new.select("name", "component")
        if new.where("was <> component").isEmpty():
            return state


def weak_parts(g: Graph) -> DataFrame:
    """(name, component) of the coupling graph: the least name that is reachable ignoring direction."""
    least = lambda n, a, b: kernels.weakly(n, *kernels.packed(n, *kernels.both_ways(a, b)))
    kernel = lambda x: x.frame(g.spark, "name string, component string", x.names[least(x.n, x.a, x.b)])
    task = lambda x: x.name(x.frame(lambda n, a, b: (least(n, a, b),), "component long"), "component").select("name", "component")
    return _either(g, kernel, task, weak_components, False)


def spanning_forest(links: DataFrame) -> DataFrame:
    """(source, target) of edges that connect what links do without a cycle. Each round joins every part by its least edge to another."""
    names = _vertices(links)
    labels = cut(names.select("name", F.col("name").alias("part")), "parts")
    left, found = links.select("source", "target"), None
    while True:
        met = left.join(labels.select(F.col("name").alias("source"), F.col("part").alias("p")), "source").join(labels.select(F.col("name").alias("target"), F.col("part").alias("q")), "target")
        left = cut(met.where("p <> q").select("source", "target", "p", "q"), "between")
        if left.isEmpty():
            return found if found is not None else left.select("source", "target")
        edge = F.struct("source", "target", "p", "q")
        least = left.select("p", edge.alias("e")).union(left.select("q", edge)).groupBy("p").agg(F.min("e").alias("e")).select("e.*").distinct()
        chosen = cut(least, "chosen")
        found = chosen.select("source", "target") if found is None else found.union(chosen.select("source", "target"))
        merged = weak_components(chosen.select(F.col("p").alias("source"), F.col("q").alias("target"))).withColumnRenamed("name", "part")
        labels = cut(labels.join(merged, "part", "left").select("name", F.coalesce("component", "part").alias("part")), "parts")
        left = left.select("source", "target")


def bridges(g: Graph) -> DataFrame:
    """(a, b), a < b: undirected coupling edges whose removal disconnects their ends.

    Beyond a task's size, edges are first cut down to a spanning forest and one of the rest, which
    have the same bridges and at most two edges a vertex; then trees are peeled (degree-one vertices),
    whose edges are bridges all.
    """
    every = _links(g)
    if KERNEL_EDGES < every.count <= TASK_EDGES:
        return _bridged(every.code())
    links = cut(every.table.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct(), "pairs")
    found, many = None, links.count()
    if many > TASK_EDGES:
        first = cut(spanning_forest(links), "forest")
        second = spanning_forest(links.join(first, ["source", "target"], "left_anti"))
        links = cut(first.union(second), "pairs")
        many = links.count()
    while many > TASK_EDGES:
        ends = links.select(F.col("source").alias("name")).union(links.select("target"))
        leaves = ends.groupBy("name").count().where("count = 1").select("name")
        peeled = cut(links.join(leaves.withColumnRenamed("name", "source"), "source", "left_semi").union(links.join(leaves.withColumnRenamed("name", "target"), "target", "left_semi")).distinct(), "peeled")
        if peeled.isEmpty():
            raise ValueError(f"more than {TASK_EDGES // 2} vertices lie on cycles; bridges of so large a graph aren't computed")
        found = peeled if found is None else found.union(peeled)
        links = cut(links.join(peeled, ["source", "target"], "left_anti"), "pairs")
        many = links.count()
    if many > KERNEL_EDGES:
        out = _bridged(Coded(links))
    else:
        x = Arrays(links)
        pairs = [(str(x.names[a]), str(x.names[b])) for a, b in kernels.bridges(x.n, *x.undirected(loops=False))]
        out = g.spark.createDataFrame(pairs, "a string, b string")
    return out if found is None else out.union(found.select("source", "target"))


def _bridged(x: Coded) -> DataFrame:
    return x.name(x.name(x.run(kernels.bridges_large, "a long, b long"), "a"), "b").select("a", "b")


def betweenness_above(g: Graph, least: float, kind: str) -> DataFrame:
    """(name, betweenness) of all vertices of components in which a node of one type can have more than `least`.

    In a component of c of n vertices none has more than (c - 1)(c - 2) / ((n - 1)(n - 2)), so there
    are few such components. There it is exact, from all sources, whatever their number.
    """
    parts = cut(weak_parts(g), "weak")
    n = parts.count()
    c = F.col("count").cast("double")
    large = parts.groupBy("component").count().where((c - 1) * (c - 2) > least * (n - 1.0) * (n - 2.0))
    members = parts.join(g.nodes.where(F.col("type") == kind).select("name"), "name", "left_semi")
    wanted = [r[0] for r in large.join(members.select("component"), "component", "left_semi").select("component").collect()]
    if not wanted:
        return g.spark.createDataFrame([], "name string, betweenness double")
    inside = parts.where(F.col("component").isin(wanted)).select(F.col("name").alias("source"))
    return betweenness(Graph(g.nodes, g.edges.join(inside, "source", "left_semi")), True, exact=True, total=n)


def betweenness(g: Graph, include: bool | None = None, exact: bool = False, total: int | None = None) -> DataFrame:
    """(name, betweenness) of the undirected coupling graph, divided by (n - 1)(n - 2).

    Without `include`, none beyond 50,000 nodes; beyond 5,000, from 500 sources chosen by hash, or from
    all if it has to be exact. n is the number of vertices, or `total` where this is a part of a graph.
    The adjacency is sent to the tasks (its size is checked), each takes a share of the sources.
    """
    schema = "name string, betweenness double"
    arm(g.spark)
    links = cut(g.links(), "links")
    if include is False or (include is None and _vertices(links).limit(BETWEENNESS_NODES + 1).count() > BETWEENNESS_NODES):
        return g.spark.createDataFrame([], schema)
    x = Arrays(links)  # of so few nodes, or of any graph that was asked for: the adjacency has to fit into a task's memory
    if x.n < 3:
        return x.frame(g.spark, schema, np.zeros(x.n))
    at, to = kernels.csr(x.n, *x.undirected())
    n, sample, total = x.n, x.n > BETWEENNESS_SAMPLED and not exact, total or x.n
    ids = g.spark.range(n, numPartitions=min(256, 1 + n // 64))
    if sample:
        ids = ids.orderBy(F.xxhash64("id"), "id").limit(BETWEENNESS_SAMPLE).repartition(32)
    shared = g.spark.sparkContext.broadcast((at, to))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shared.value
        credit = np.zeros(n)
        for batch in batches:
            credit += kernels.dependencies(n, a, b, batch.column("id").to_pylist())
        hit = np.flatnonzero(credit)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(credit[hit])], names=["id", "part"])

    parts = ids.mapInArrow(share, "id long, part double").groupBy("id").agg(F.sum("part").alias("total"))
    scale = (n / BETWEENNESS_SAMPLE if sample else 1.0) / ((total - 1) * (total - 2))
    names = x.frame(g.spark, "name string, id long", np.arange(n))
    return names.join(parts, "id", "left").select("name", F.coalesce(F.col("total") * scale, F.lit(0.0)).alias("betweenness"))


def innermost(g: Graph) -> DataFrame:
    """(name, core) of the innermost core's members."""
    cores = cut(kcore(g), "cores")
    return cores.join(cores.agg(F.max("core").alias("core")), "core").select("name", "core")
