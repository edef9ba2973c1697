"""The property graph: a nodes and an edges DataFrame, and how they change.

nodes: name, type, file, line, end_line, docstring, cc (cyclomatic complexity), entry_point,
content_hash, structure_hash, provenance, metadata (residual JSON).
edges: source, rel, target, provenance, metadata; (source, rel, target) is the key.
Types and relationships are open sets of strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_TYPES = ("package", "module", "class", "function", "method", "interface", "variable", "constant", "type", "endpoint", "config")
REL_TYPES = ("calls", "inherits", "implements", "contains", "depends_on", "imports", "returns", "accepts", "overrides", "decorates", "tests")
#: Relationships that couple code entities; all metrics of §2.4 and §2.5 use exactly these.
COUPLING = ("calls", "depends_on", "implements", "imports", "inherits")

NODE_SCHEMA = T.StructType(
    [T.StructField("name", T.StringType(), False), T.StructField("type", T.StringType(), False), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]
    + [T.StructField("docstring", T.StringType()), T.StructField("cc", T.IntegerType()), T.StructField("entry_point", T.BooleanType())]
    + [T.StructField(c, T.StringType()) for c in ("content_hash", "structure_hash", "provenance", "metadata")]
)
EDGE_SCHEMA = T.StructType([T.StructField(c, T.StringType(), c in ("provenance", "metadata")) for c in ("source", "rel", "target", "provenance", "metadata")])


def coupling(rel: str = "rel") -> Column:
    return F.col(rel).isin(*COUPLING)


@dataclass(frozen=True)
class Graph:
    """Two lazy DataFrames. Operators read from them; changes make new graphs."""

    nodes: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def containment(self) -> DataFrame:
        """The edges that contain."""
        return self.edges.where("rel = 'contains'")

    @property
    def relations(self) -> DataFrame:
        """All other edges."""
        return self.edges.where("rel <> 'contains'")

    @property
    def closed(self) -> bool:
        """Whether it is known that both ends of all relations are nodes."""
        return False

    @staticmethod
    def of(spark: SparkSession, nodes: list[dict], edges: list[tuple[str, str, str]]) -> Graph:
        rows = [tuple(n.get(f.name) for f in NODE_SCHEMA.fields) for n in nodes]
        return Graph(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame([(*e, None, None) for e in edges], EDGE_SCHEMA))

    def links(self) -> DataFrame:
        """The coupling graph: distinct (source, target) over coupling relationships; self-loops stay."""
        return self.relations.where(coupling()).select("source", "target").distinct()

    def contains(self) -> DataFrame:
        """(parent, child); of several parents of a child the least."""
        return self.containment.groupBy(F.col("target").alias("child")).agg(F.min("source").alias("parent"))

    def scope(self, prefix: str) -> Graph:
        """The subgraph induced by a dotted prefix."""
        nodes = self.nodes.where(under(F.col("name"), prefix))
        edges = self.edges.where(under(F.col("source"), prefix) & under(F.col("target"), prefix))
        names = nodes.select("name")
        return Graph(nodes, edges.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi").select(*self.edges.columns))

    # Mutations

    def upsert(self, new: DataFrame) -> Graph:
        """Adds nodes or updates them: the type always, other columns where the new value is not null; metadata keys merge."""
        new = new.select([F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA.fields])
        old = self.nodes.select(NODE_SCHEMA.fieldNames())
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        pick = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__new"))).alias(c) for c in NODE_SCHEMA.fieldNames() if c not in ("name", "metadata")]
        kind = "map<string,string>"
        merged = F.map_concat(*(F.coalesce(F.from_json(F.max(F.when(F.col("__new") == k, F.col("metadata"))), kind), F.expr("map()").cast(kind)) for k in (0, 1)))
        had = F.max("metadata").isNotNull()
        self.spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        return Graph(both.groupBy("name").agg(*pick, F.when(had, F.to_json(merged)).alias("metadata")), self.edges)

    def missing(self, new: DataFrame) -> DataFrame:
        """(edge ends of new that are no node): one row per missing name."""
        ends = new.select(F.col("source").alias("name")).union(new.select(F.col("target").alias("name"))).distinct()
        return ends.join(self.nodes.select("name"), "name", "left_anti")

    def link(self, new: DataFrame) -> Graph:
        """Adds edges; an edge of the same key replaces the old one. Fails where an end is missing."""
        absent = [r[0] for r in self.missing(new).orderBy("name").limit(5).collect()]
        if absent:
            raise KeyError(f"no such node: {', '.join(absent)}")
        new = new.select([F.col(c) if c in new.columns else F.lit(None).cast("string").alias(c) for c in EDGE_SCHEMA.fieldNames()])
        old = self.edges.select(EDGE_SCHEMA.fieldNames()).join(new, ["source", "rel", "target"], "left_anti")
        return Graph(self.nodes, old.unionByName(new))

    def remove(self, names: DataFrame) -> Graph:
        """Removes nodes (names.name) with all edges at them."""
        gone = names.select("name").distinct()
        edges = self.edges
        for end in ("source", "target"):
            edges = edges.join(gone.withColumnRenamed("name", end), end, "left_anti")
        return Graph(self.nodes.join(gone, "name", "left_anti"), edges.select(*self.edges.columns))

    def unlink(self, edges: DataFrame) -> Graph:
        absent = edges.join(self.edges, ["source", "rel", "target"], "left_anti").limit(1).collect()
        if absent:
            raise KeyError(f"no such edge: {absent[0].asDict()}")
        return Graph(self.nodes, self.edges.join(edges, ["source", "rel", "target"], "left_anti").select(*self.edges.columns))

    def validate(self) -> DataFrame:
        """One row per dangling end: source, rel, target, missing."""
        names = self.nodes.select("name")
        found = [self.edges.join(names.withColumnRenamed("name", end), end, "left_anti").select("source", "rel", "target", F.col(end).alias("missing")) for end in ("source", "target")]
        return found[0].union(found[1])


def under(name: Column, prefix: str) -> Column:
    """A dotted prefix: the name itself or anything below it."""
    return (name == prefix) | name.startswith(f"{prefix}.")
