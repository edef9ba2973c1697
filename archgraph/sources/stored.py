"""Stored graphs, rules and concepts: JSON lines for exchange, Parquet by relationship for work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from archgraph.operators.concepts import Concept
from archgraph.operators.rules import Rule
from archgraph.sources.export import to_json

_LINE = "kind string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODE_SCHEMA.fields) + ", source string, rel string, target string"


def read_jsonl(spark: SparkSession, path: str) -> Graph:
    """Blank lines and unknown kinds are ignored; an edge whose end is missing is an error."""
    return from_lines(spark.read.text(path))


def from_lines(lines: DataFrame) -> Graph:
    """The graph of JSON lines (value); of several for one node or edge the last stands."""
    lines = lines.where("trim(value) <> ''").select(F.from_json("value", _LINE).alias("x")).select("x.*")
    later = F.monotonically_increasing_id()
    rows = lines.where("kind in ('node', 'edge')").withColumn("__at", later)
    nodes = rows.where("kind = 'node'").groupBy("name").agg(*(F.max_by(f.name, F.when(F.col(f.name).isNotNull(), F.col("__at"))).alias(f.name) for f in NODE_SCHEMA.fields[1:]))
    edges = rows.where("kind = 'edge'").groupBy("source", "rel", "target").agg(F.max_by("provenance", "__at").alias("provenance"), F.max_by("metadata", "__at").alias("metadata"))
    g = Graph(nodes.select(NODE_SCHEMA.fieldNames()), edges.select(EDGE_SCHEMA.fieldNames()))
    broken = g.validate().limit(1).collect()
    if broken:
        raise ValueError(f"dangling edge: {broken[0].asDict()}")
    return g


def write_jsonl(g: Graph, path: str) -> None:
    """Nodes by name, then edges by key. The committer renames, so readers see all or nothing."""
    to_json(g).select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select(EDGE_SCHEMA.fieldNames()))


def write_parquet(g: Graph, path: str) -> None:
    """Edges are partitioned by relationship, so that a filter on it prunes files."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    schema = "name string, type string, pattern string, invariant string, selector string, assertion string, params map<string,string>, scope string"
    return [Rule(**(r.asDict() | {"params": r["params"] or {}})) for r in spark.read.schema(schema).json(path).where("name is not null").orderBy("name").collect()]


def write_rules(spark: SparkSession, rules: list[Rule], path: str) -> None:
    schema = "name string, type string, pattern string, invariant string, selector string, assertion string, params map<string,string>, scope string"
    rows = [(r.name, r.type, r.pattern, r.invariant, r.selector, r.assertion, r.params or None, r.scope) for r in sorted(rules, key=lambda r: r.name)]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(path)


def read_concepts(spark: SparkSession, path: str) -> list[Concept]:
    rows = spark.read.schema("name string, prefixes array<string>, sync_points array<string>").json(path).where("name is not null").orderBy("name").collect()
    return [Concept(r["name"], tuple(dict.fromkeys(r["prefixes"] or ())), tuple(dict.fromkeys(r["sync_points"] or ()))) for r in rows]


def write_concepts(spark: SparkSession, concepts: list[Concept], path: str) -> None:
    rows = [(c.name, list(c.prefixes), list(c.sync_points)) for c in sorted(concepts, key=lambda c: c.name)]
    spark.createDataFrame(rows, "name string, prefixes array<string>, sync_points array<string>").coalesce(1).write.mode("overwrite").json(path)


def apply_batch(g: Graph, ops: DataFrame) -> tuple[Graph, DataFrame]:
    """(new graph, errors) for ops(seq, op, name, type, docstring, source, rel, target): add, update, rm, link, unlink.

    Of several operations on one node or edge the last by seq stands; links to missing nodes are errors.
    """
    on_nodes = ops.where("op in ('add', 'update', 'rm')").groupBy("name").agg(*(F.max_by(c, "seq").alias(c) for c in ("op",)), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in ("type", "docstring")))
    absent = on_nodes.where("op <> 'add'").join(g.nodes.select("name"), "name", "left_anti")
    errors = absent.select("name", F.lit("no such node").alias("error"))
    new = on_nodes.where("op <> 'rm'").join(absent.select("name"), "name", "left_anti").join(g.nodes.select("name", F.col("type").alias("had")), "name", "left").select("name", F.coalesce("type", "had").alias("type"), "docstring")
    g = g.remove(on_nodes.where("op = 'rm'").select("name")).upsert(new)
    on_edges = ops.where("op in ('link', 'unlink')").groupBy("source", "rel", "target").agg(F.max_by("op", "seq").alias("op"))
    links = on_edges.where("op = 'link'").select("source", "rel", "target")
    known = g.nodes.select("name")
    good = links.join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi").select("source", "rel", "target")
    bad = links.join(good, ["source", "rel", "target"], "left_anti").select(F.concat_ws(" ", "source", "rel", "target").alias("name"), F.lit("no such end").alias("error"))
    gone = on_edges.where("op = 'unlink'").select("source", "rel", "target")
    edges = g.edges.join(gone, ["source", "rel", "target"], "left_anti").join(good, ["source", "rel", "target"], "left_anti").select(EDGE_SCHEMA.fieldNames())
    fresh = good.select("source", "rel", "target", F.lit("manual").alias("provenance"), F.lit(None).cast("string").alias("metadata"))
    return Graph(g.nodes, edges.unionByName(fresh)), errors.union(bad)
