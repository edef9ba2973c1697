"""Filters, look-ups, incident edges and small summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.model import COUPLING, Graph, coupling


def nodes_of_type(g: Graph, kind: str) -> DataFrame:
    return g.nodes.where(F.col("type") == kind)


def edges_of(g: Graph, *rels: str) -> DataFrame:
    return g.edges.where(F.col("rel").isin(*rels))


def suffixes(name: Column) -> Column:
    """All dotted suffixes of a name, itself included."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))


def resolve(g: Graph, names: DataFrame) -> DataFrame:
    """(query, name) for names.query: the exact node if there is one, else all whose dotted suffix it is.

    An equi-join over exploded suffixes, so that many names are resolved in one pass.
    """
    exact = names.join(g.nodes.select("name"), F.col("query") == F.col("name")).select("query", "name")
    ends = g.nodes.select("name", F.explode(suffixes(F.col("name"))).alias("query"))
    others = names.join(exact.select("query"), "query", "left_anti").join(ends, "query").select("query", "name")
    return exact.union(others)


def one(g: Graph, query: str) -> str:
    """The only node a short name can mean."""
    exact = g.nodes.where(F.col("name") == query).select("name").limit(1).collect()
    found = exact or g.nodes.where(F.col("name").endswith(f".{query}")).select("name").orderBy("name").limit(6).collect()
    if len(found) != 1:
        raise LookupError(f"{query!r} is {'ambiguous: ' + ', '.join(r[0] for r in found) if found else 'unknown'}")
    return found[0][0]


def incident(g: Graph, name: str, direction: str = "out", rel: str | None = None) -> DataFrame:
    end = "source" if direction == "out" else "target"
    found = g.edges.where(F.col(end) == name)
    return (found.where(F.col("rel") == rel) if rel else found).select("source", "rel", "target")


def neighbors(g: Graph, name: str, direction: str = "both", rels: tuple[str, ...] | None = None) -> DataFrame:
    edges = g.edges.where(F.col("rel").isin(*rels)) if rels else g.edges
    ahead = edges.where(F.col("source") == name).select(F.col("target").alias("name"))
    back = edges.where(F.col("target") == name).select(F.col("source").alias("name"))
    return {"out": ahead, "in": back, "both": ahead.union(back)}[direction].distinct()


def glob(name: Column, pattern: str) -> Column:
    """fnmatch on names: * and ? cross dots, [seq] and [!seq] are classes. LIKE wherever it suffices."""
    if not re.search(r"\[", pattern):
        escaped = re.sub(r"([\\%_])", r"\\\1", pattern)
        return name.like(escaped.replace("*", "%").replace("?", "_"))
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            inside = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + inside[1:] if inside[:1] == "!" else "\\" + inside if inside[:1] == "^" else inside) + "]"
            i = end + 1
        else:
            out += re.sub(r"([^\w\s])", r"\\\1", c)
    return name.rlike(rf"(?s)\A{out}\z")


def short_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def is_entry_point() -> Column:
    """Nodes that are used from outside by convention: flagged, main, tests, constants, dunders of Python."""
    short = short_name(F.col("name"))
    shouting = (F.upper(short) == short) & (F.lower(short) != short)
    python = F.coalesce(F.col("file").endswith(".py"), F.lit(False))
    return (
        F.coalesce(F.col("entry_point"), F.lit(False)) | (short == "main")
        | (F.col("type").isin("constant", "variable") & shouting)
        | short.startswith("test_") | short.startswith("Test")
        | (python & ((short == "__main__") | (short.startswith("__") & short.endswith("__"))))
    )


def status(g: Graph) -> DataFrame:
    """Counts by node type and relationship."""
    return (
        g.nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).count().withColumnRenamed("count", "n")
        .union(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).count())
    )


def degrees(g: Graph) -> DataFrame:
    """Incoming and outgoing edge counts of every node, all relationships."""
    ends = g.edges.select(F.col("source").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(g.edges.select("target", F.lit(0), F.lit(1)))
    sums = ends.groupBy("name").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    return g.nodes.select("name", "type").join(sums, "name", "left").na.fill(0, ["incoming", "outgoing"])


def overview(g: Graph, top: int = 10) -> DataFrame:
    """The most connected nodes: a report of the first `top`."""
    return degrees(g).withColumn("degree", F.col("incoming") + F.col("outgoing")).orderBy(F.desc("degree"), "name").limit(top)


def usages(g: Graph, name: str, rels: tuple[str, ...] = COUPLING) -> DataFrame:
    """Who couples to a node: caller with file and lines, blank and 0 where unknown."""
    hits = g.edges.where((F.col("target") == name) & F.col("rel").isin(*rels)).select("source", "rel")
    return hits.join(g.nodes.select(F.col("name").alias("source"), F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("end_line", F.lit(0)).alias("end_line")), "source")


def delta(findings: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """Only findings about names.name."""
    return findings.join(names.select(F.col("name").alias(column)).distinct(), column, "left_semi")


def about(g: Graph, name: str, coupling_only: bool = True) -> DataFrame:
    """The edges of a node's card: direction, rel, other; containment is always shown."""
    shown = coupling() | (F.col("rel") == "contains") if coupling_only else F.lit(True)
    ahead = g.edges.where((F.col("source") == name) & shown).select(F.lit("out").alias("direction"), "rel", F.col("target").alias("other"))
    return ahead.union(g.edges.where((F.col("target") == name) & shown).select(F.lit("in"), "rel", "source"))
