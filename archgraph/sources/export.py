"""Sinks: JSON, text, Mermaid, DOT and the design structure matrix.

Each is a DataFrame of lines in order, so that large graphs are written by tasks; `lines` of a
small one can be collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions.scalars import identifier
from archgraph.model import COUPLING, Graph
from archgraph.operators.traverse import containing


def _in_order(*parts: DataFrame) -> DataFrame:
    """(part, key, line) of all parts, ordered."""
    out = None
    for i, p in enumerate(parts):
        p = p.select(F.lit(i).alias("part"), F.col("key").cast("string").alias("key"), "line")
        out = p if out is None else out.union(p)
    return out.orderBy("part", "key")


def _fixed(g: Graph, text: str) -> DataFrame:
    return g.spark.createDataFrame([("", text)], "key string, line string")


def _edge_key() -> Column:
    return F.concat_ws("\x01", "source", "rel", "target").alias("key")


def to_json(g: Graph) -> DataFrame:
    """One JSON object a line, nodes before edges, each with its kind; null fields are left out."""
    nodes = g.nodes.select(F.col("name").alias("key"), F.to_json(F.struct(F.lit("node").alias("kind"), *g.nodes.columns)).alias("line"))
    edges = g.edges.select(_edge_key(), F.to_json(F.struct(F.lit("edge").alias("kind"), *g.edges.columns)).alias("line"))
    return _in_order(nodes, edges)


def to_text(g: Graph) -> DataFrame:
    place = F.when(F.col("file").isNotNull(), F.concat(F.lit("  "), F.concat_ws(":", "file", F.col("line").cast("string")))).otherwise("")
    nodes = g.nodes.select(F.col("name").alias("key"), F.concat(F.lit("["), "type", F.lit("] "), "name", place).alias("line"))
    return _in_order(nodes, g.edges.select(_edge_key(), F.format_string("%s --%s--> %s", "source", "rel", "target").alias("line")))


def to_mermaid(g: Graph) -> DataFrame:
    nodes = g.nodes.select(F.col("name").alias("key"), F.format_string('    %s["%s (%s)"]', identifier(F.col("name")), "name", "type").alias("line"))
    edges = g.edges.select(_edge_key(), F.format_string("    %s -->|%s| %s", identifier(F.col("source")), "rel", identifier(F.col("target"))).alias("line"))
    return _in_order(_fixed(g, "graph LR"), nodes, edges)


def to_dot(g: Graph) -> DataFrame:
    nodes = g.nodes.select(F.col("name").alias("key"), F.format_string('  %s [label="%s\\n(%s)"];', identifier(F.col("name")), "name", "type").alias("line"))
    edges = g.edges.select(_edge_key(), F.format_string('  %s -> %s [label="%s"];', identifier(F.col("source")), identifier(F.col("target")), "rel").alias("line"))
    return _in_order(_fixed(g, "digraph G {"), nodes, edges, _fixed(g, "}"))


def dsm_cells(g: Graph, level: str = "module") -> DataFrame:
    """(row, col, n): coupling edges between the nearest modules (or classes, or nodes: `all`) of their ends, without the diagonal."""
    edges = g.relations.where(F.col("rel").isin(*COUPLING)).select("source", "target")
    if level != "all":
        near = containing(g, (level,))
        edges = edges.join(near.select(F.col("name").alias("source"), F.col("owner").alias("row")), "source").join(near.select(F.col("name").alias("target"), F.col("owner").alias("col")), "target")
    else:
        edges = edges.select(F.col("source").alias("row"), F.col("target").alias("col"))
    return edges.where("row <> col").groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


def to_dsm(g: Graph, level: str = "module", most: int = 1000) -> DataFrame:
    """The matrix as a wide table; for more than `most` modules use the cells."""
    cells = dsm_cells(g, level)
    names = g.nodes.where(F.col("type") == level).select("name") if level != "all" else g.nodes.select("name")
    columns = [r[0] for r in names.orderBy("name").limit(most + 1).collect()]
    if len(columns) > most:
        raise ValueError(f"over {most} columns: use dsm_cells")
    wide = cells.groupBy("row").pivot("col", columns).agg(F.sum("n"))
    return names.withColumnRenamed("name", "row").join(wide, "row", "left").na.fill(0).orderBy("row")
