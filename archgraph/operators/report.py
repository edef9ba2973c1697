"""Hotspots and the one table of all metrics by node."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.model import Graph
from archgraph.operators import analytics, concepts, oo
from archgraph.store import cut


def class_metrics(g: Graph) -> DataFrame:
    out = oo.wmc(g)
    for metric in (oo.dit, oo.noc, oo.cbo, oo.rfc, oo.lcom4):
        out = out.join(metric(g), "class")
    return out


def node_metrics(g: Graph) -> DataFrame:
    """One row per node: degrees, rank, layer, core, cycle and death."""
    out = g.nodes.select("name", "type")
    for metric in (analytics.fan_in_out(g), analytics.pagerank(g), analytics.layers(g), analytics.kcore(g), analytics.find_cycles(g).select("name", F.lit(True).alias("in_cycle")), oo.dead_code(g).select("name", F.lit(True).alias("dead"))):
        out = out.join(metric, "name", "left")
    return out.na.fill(0).na.fill(False)


def hotspots(
    g: Graph, touches: DataFrame | None = None, centrality: DataFrame | None = None, classes: DataFrame | None = None, rank: DataFrame | None = None, martin: DataFrame | None = None
) -> DataFrame:
    """(name, type, score, reasons): classes, modules and functions that several metrics point at. Metrics known already are passed on.

    Without centrality, the exact betweenness is computed wherever it can count.
    """
    blank = g.spark.createDataFrame([], "name string, touches long")
    touches = blank if touches is None else touches
    touches = cut(touches, "touches")  # met twice
    central = analytics.betweenness_above(g, 0.05, "class") if centrality is None else centrality
    rank = analytics.pagerank(g) if rank is None else rank
    table = (class_metrics(g) if classes is None else classes).withColumnRenamed("class", "name").join(rank, "name", "left").join(central, "name", "left").join(touches, "name", "left").na.fill(0)
    terms = [
        (F.col("wmc") > 20, F.col("wmc") / 10, "WMC %d", "wmc"), (F.col("cbo") > 5, F.col("cbo") * 1.0, "CBO %d", "cbo"), (F.col("lcom4") > 1, F.col("lcom4") * 3.0, "LCOM4 %d", "lcom4"),
        (F.col("rfc") > 20, F.col("rfc") / 5, "RFC %d", "rfc"), (F.col("betweenness") > 0.05, F.col("betweenness") * 20, "betweenness %.3f", "betweenness"),
        (F.col("pagerank") > 0.02, F.col("pagerank") * 50, "pagerank %.3f", "pagerank"), (F.col("touches") > 10, F.col("touches") / 5, "%d touches", "touches"),
    ]
    score = sum((F.when(t, s).otherwise(0.0) for t, s, _, _ in terms), F.lit(0.0))
    reasons = F.concat_ws(", ", *(F.when(t, F.format_string(text, c)) for t, _, text, c in terms))
    classes = table.select("name", F.lit("class").alias("type"), score.alias("score"), reasons.alias("reasons")).where("score > 0")
    far = (oo.martin(g) if martin is None else martin).where("distance > 0.7").join(g.nodes.select(F.col("name").alias("module"), "type"), "module")
    modules = far.select(F.col("module").alias("name"), "type", (F.col("distance") * 5).alias("score"), F.format_string("distance %.2f", "distance").alias("reasons"))
    code = g.nodes.where("type in ('function', 'method')").join(touches, "name").select("name", "type", "touches", F.coalesce("cc", F.lit(1)).alias("cc"))
    busy, complex_ = F.col("touches") > 5, F.col("cc") > 10
    both = F.when(busy, F.col("touches") / 5).otherwise(0.0) + F.when(complex_, F.col("cc") / 5).otherwise(0.0)
    functions = code.select("name", "type", both.alias("score"), F.concat_ws(", ", F.when(busy, F.format_string("%d touches", "touches")), F.when(complex_, F.format_string("complexity %d", "cc"))).alias("reasons")).where("score > 2.0")
    return classes.union(modules).union(functions).withColumn("score", F.bround("score", 2))


def run_analysis(
    g: Graph, hunks: DataFrame | None = None, full: bool = True, declared: list[concepts.Concept] | None = None, include_betweenness: bool | None = None, on_step: Callable[[str], None] | None = None
) -> dict[str, DataFrame]:
    """All metrics and findings by name, each computed once and written; hunks add churn, declared concepts their analysis.

    Without `full`, fans and HITS are left out.
    """
    from archgraph.operators import history

    g = Graph(cut(g.nodes, "nodes"), cut(g.edges, "edges"))
    steps: dict[str, Callable[[], DataFrame]] = {
        "cycles": lambda: analytics.find_cycles(g), "layers": lambda: analytics.layers(g), "pagerank": lambda: analytics.pagerank(g), "betweenness": lambda: analytics.betweenness(g, include_betweenness),
        "kcore": lambda: analytics.kcore(g), "bridges": lambda: analytics.bridges(g), "classes": lambda: class_metrics(g), "martin": lambda: oo.martin(g), "sdp_violations": lambda: oo.sdp_violations(g),
        "dead_code": lambda: oo.dead_code(g), "layering_violations": lambda: analytics.layering_violations(g), "god_classes": lambda: oo.god_classes(g), "feature_envy": lambda: oo.feature_envy(g),
        "shotgun_surgery": lambda: oo.shotgun_surgery(g), "god_files": lambda: oo.god_files(g),
    }
    if hunks is not None:
        steps["churn"] = lambda: history.entity_churn(g, hunks)
    if full:
        steps |= {"fans": lambda: analytics.fan_in_out(g), "hits": lambda: analytics.hits(g)}
    if declared is not None:
        steps |= {"concepts": lambda: concepts.summary(g, declared), "concept_dependencies": lambda: concepts.dependencies(g, declared)}
    out = {}
    for name, step in steps.items():
        if on_step:
            on_step(name)
        out[name] = cut(step(), name)
    out["hotspots"] = cut(hotspots(g, out.get("churn"), out["betweenness"], out["classes"], out["pagerank"], out["martin"]), "hotspots")
    return out


def only(results: dict[str, DataFrame], names: DataFrame) -> dict[str, DataFrame]:
    """The findings about names.name: of edges, those with an end among them."""
    wanted = names.select("name").distinct()
    out = dict(results)
    for key, columns in {"hotspots": ("name",), "dead_code": ("name",), "layering_violations": ("source", "target"), "god_classes": ("class",), "feature_envy": ("method",), "shotgun_surgery": ("name",)}.items():
        if key in results:
            hits = [results[key].join(wanted.withColumnRenamed("name", c), c, "left_semi").select(*results[key].columns) for c in columns]
            out[key] = hits[0] if len(hits) == 1 else hits[0].union(hits[1]).distinct()
    return out
