"""Context packing: what to show about a node within a budget of tokens."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.model import COUPLING, Graph
from archgraph.operators.traverse import levels

SCHEMA = "position int, name string, type string, tier int, level string, tokens int, text string"


def count_tokens(text: str) -> int:
    return max(1, len(text) // 4)


@dataclass(frozen=True)
class Entry:
    name: str
    type: str
    tier: int
    text: dict[str, str]


def neighborhood(g: Graph, name: str) -> DataFrame:
    """(name, type, file, line, docstring, tier, side): the target, coupling neighbors, and rings two and three over all edges."""
    start = g.nodes.where(F.col("name") == name).select("name")
    near = levels(g.edges, start, "both", 3)
    links = g.edges.where(F.col("rel").isin(*COUPLING))
    direct = links.where(F.col("source") == name).select(F.col("target").alias("name"), F.lit(0).alias("side")).union(links.where(F.col("target") == name).select("source", F.lit(1)))
    direct = direct.where(F.col("name") != name).groupBy("name").agg(F.min("side").alias("side"))
    tiers = near.join(direct, "name", "left").where("depth <> 1 or side is not null").select("name", F.col("depth").alias("tier"), F.coalesce("side", F.lit(0)).alias("side"))
    return g.nodes.join(tiers, "name").select("name", "type", "file", "line", "docstring", "tier", "side")


def pack(g: Graph, name: str, budget: int = 4000, tokens: Callable[[str], int] = count_tokens, source: Callable[[str], str] | None = None) -> DataFrame:
    """Entries in order, each at the richest level that fits: full (with `source`), signature, summary; else skipped.

    Neighbors come nearest first; only as many as the budget can hold at all are fetched.
    """
    tiers = neighborhood(g, name)
    rows = tiers.orderBy("tier", "side", "name").limit(budget + 1).collect()  # an entry has a token at least
    out, left = [], budget
    for r in rows:
        doc = (r["docstring"] or "").strip().split("\n")[0]
        where = f" ({r['file']}:{r['line']})" if r["file"] and r["line"] else ""
        text = {"signature": f"{r['type']} {r['name']}{where}" + (f": {doc}" if doc else ""), "summary": f"{r['type']} {r['name']}"}
        if source and r["tier"] <= 1 and (full := source(r["name"])):
            text = {"full": full, **text}
        for level, shown in text.items():
            if level == "signature" and r["tier"] == 3:
                continue
            n = tokens(shown)
            if n <= left or not r["tier"]:
                out.append((len(out), r["name"], r["type"], r["tier"], level, n, shown))
                left -= n
                break
    return g.spark.createDataFrame(out, SCHEMA)
