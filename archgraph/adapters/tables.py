"""The relational test tables as a property graph: in SQL for DuckDB, and over keys for Spark.

Regions are packages, nations modules, customers classes, suppliers interfaces, orders methods;
a catalogue package holds brands (modules) and parts (functions). Orders call parts and depend
on suppliers, parts call the part that follows in an order, nations import nations they trade
with, and customers inherit along c_custkey div 2.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from archgraph.store import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_S = "cast({} as string)".format
_NATION = f"'r' || {_S('n_regionkey')} || '.n' || {_S('n_nationkey')}"

#: CTEs up to nodes and edges.
GRAPH_SQL = f"""
v_nation AS (SELECT n_nationkey, {_NATION} AS name, 'n' || {_S('n_nationkey')} || '.src' AS file, 'r' || {_S('n_regionkey')} AS parent FROM {{nation}}
), v_customer AS (SELECT c_custkey, c_nationkey, n.name || '.C' || {_S('c_custkey')} AS name, n.name AS parent, n.file FROM {{customer}} JOIN v_nation n ON n_nationkey = c_nationkey
), v_supplier AS (SELECT s_suppkey, s_nationkey, n.name || '.S' || {_S('s_suppkey')} AS name, n.name AS parent, n.file FROM {{supplier}} JOIN v_nation n ON n_nationkey = s_nationkey
), v_lines AS (SELECT l_orderkey, cast(count(*) as int) AS cc FROM {{lineitem}} GROUP BY l_orderkey
), v_order AS (SELECT o_orderkey, c.c_nationkey, c.name || '.o' || {_S('o_orderkey')} AS name, c.name AS parent, c.file, cast(1 + 10 * (o_orderkey % 1000) as int) AS line, l.cc
  FROM {{orders}} JOIN v_customer c ON c.c_custkey = o_custkey LEFT JOIN v_lines l ON l_orderkey = o_orderkey
), v_part AS (SELECT p_partkey, p_size, p_name, 'cat.b' || replace(p_brand, 'Brand#', '') AS parent, 'b' || replace(p_brand, 'Brand#', '') || '.src' AS file,
  'cat.b' || replace(p_brand, 'Brand#', '') || '.p' || {_S('p_partkey')} AS name FROM {{part}}
), nodes AS (
  SELECT 'r' || {_S('r_regionkey')} AS name, 'package' AS type, cast(null as string) AS file, cast(null as int) AS line, cast(null as int) AS end_line, cast(null as string) AS docstring, cast(null as int) AS cc FROM {{region}}
  UNION ALL SELECT name, 'module', file, null, null, null, null FROM v_nation
  UNION ALL SELECT name, 'class', file, null, null, null, null FROM v_customer
  UNION ALL SELECT name, 'interface', file, null, null, null, null FROM v_supplier
  UNION ALL SELECT name, 'method', file, line, line + 9, null, cc FROM v_order
  UNION ALL SELECT 'cat', 'package', null, null, null, null, null
  UNION ALL SELECT DISTINCT parent, 'module', file, cast(null as int), cast(null as int), cast(null as string), cast(null as int) FROM v_part
  UNION ALL SELECT name, 'function', file, null, null, p_name, p_size FROM v_part
), v_hot AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM {{lineitem}} WHERE l_returnflag = 'R' AND l_quantity >= 30
), v_next AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM v_hot
), edges AS (
  SELECT parent AS source, 'contains' AS rel, name AS target FROM v_nation UNION ALL SELECT parent, 'contains', name FROM v_customer UNION ALL SELECT parent, 'contains', name FROM v_supplier
  UNION ALL SELECT parent, 'contains', name FROM v_order UNION ALL SELECT parent, 'contains', name FROM v_part UNION ALL SELECT DISTINCT 'cat', 'contains', parent FROM v_part
  UNION ALL SELECT DISTINCT o.name, 'calls', p.name FROM v_hot JOIN v_order o ON o_orderkey = l_orderkey JOIN v_part p ON p_partkey = l_partkey
  UNION ALL SELECT DISTINCT o.name, 'depends_on', s.name FROM v_hot JOIN v_order o ON o_orderkey = l_orderkey JOIN v_supplier s ON s_suppkey = l_suppkey
  UNION ALL SELECT DISTINCT p.name, 'calls', q.name FROM v_next JOIN v_part p ON p.p_partkey = a JOIN v_part q ON q.p_partkey = b WHERE a <> b
  UNION ALL SELECT DISTINCT n.name, 'imports', m.name FROM v_hot JOIN v_order o ON o_orderkey = l_orderkey JOIN v_supplier s ON s_suppkey = l_suppkey
    JOIN v_nation n ON n.n_nationkey = o.c_nationkey JOIN v_nation m ON m.n_nationkey = s.s_nationkey WHERE n.n_nationkey <> m.n_nationkey
  UNION ALL SELECT c.name, 'inherits', d.name FROM v_customer c JOIN v_customer d ON d.c_custkey = cast(floor(c.c_custkey / 2) as bigint) WHERE c.c_custkey >= 1
)"""


def graph_sql() -> str:
    """The CTEs over views that are named as the tables; nodes and edges are computed once."""
    text = GRAPH_SQL.format(**{t: t for t in TABLES})
    return text.replace("), nodes AS (", "), nodes AS MATERIALIZED (").replace("), edges AS (", "), edges AS MATERIALIZED (")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], Graph] = {}


class Ingested(Graph):
    """A graph over the tables whose nodes, containment and other edges are each written when first asked for."""

    def __init__(self, **parts: Callable[[], DataFrame]):
        object.__setattr__(self, "_parts", parts)
        object.__setattr__(self, "_found", {})

    def _part(self, name: str) -> DataFrame:
        if name not in self._found:
            self._found[name] = cut(self._parts[name](), name)
        return self._found[name]

    @property
    def nodes(self) -> DataFrame:
        return self._part("nodes")

    @property
    def containment(self) -> DataFrame:
        return self._part("containment")

    @property
    def relations(self) -> DataFrame:
        return self._part("relations")

    @property
    def edges(self) -> DataFrame:
        if "edges" not in self._found:
            self._found["edges"] = self.containment.union(self.relations)
        return self._found["edges"]

    @property
    def closed(self) -> bool:
        """The relations' ends are made of the same joins as the nodes."""
        return True


def graph(spark: SparkSession, sf_dir: str, orders: str = "true") -> Graph:
    """The graph over the tables, ingested once into the shared folder and read from there by every query."""
    key = (spark.sparkContext.applicationId, sf_dir, orders)
    if key not in _STORED:
        _STORED[key] = Ingested(**_build(spark, sf_dir, orders))
    return _STORED[key]


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, type, docstring) of the graph's nodes: read, if they are written, else put together without counting lines."""
    g = graph(spark, sf_dir)
    return (g._found["nodes"] if "nodes" in g._found else g._parts["described"]()).select("name", "type", "docstring")


def build(spark: SparkSession, sf_dir: str, orders: str = "true") -> Graph:
    """The graph over the tables; `orders` restricts the orders by a predicate (for diffs)."""
    made = _build(spark, sf_dir, orders)
    return Graph(made["nodes"](), made["containment"]().union(made["relations"]()))


def _build(spark: SparkSession, sf_dir: str, orders: str) -> dict[str, Callable[[], DataFrame]]:
    """What GRAPH_SQL says, over keys: they are joined, made distinct and written once, and names are put together last.

    So no name is shuffled, orders and lines are each shuffled once or twice as integers, and the lines'
    distinct parts and suppliers are told within the shuffle by order that they need anyway.
    """
    t = {name: table(spark, sf_dir, name) for name in TABLES}
    t["orders"] = t["orders"].where(orders)
    nations = [tuple(r) for r in t["nation"].select("n_nationkey", "n_regionkey").collect()]  # a fixed small table
    n = F.broadcast(spark.createDataFrame(nations, t["nation"].select("n_nationkey", "n_regionkey").schema))
    in_nation = "'r' || n_regionkey || '.n' || n_nationkey"
    src = "'n' || n_nationkey || '.src'"
    blank = {"file": "string", "line": "int", "end_line": "int", "docstring": "string", "cc": "int"}
    memo: dict[str, DataFrame] = {}

    def once(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in memo:
            memo[name] = cut(make(), name)
        return memo[name]

    def node(df: DataFrame, name: str, kind: str, **known: str) -> DataFrame:
        rest = [f"cast({known.get(f.name, 'null')} as {blank.get(f.name, f.dataType.simpleString())}) as {f.name}" for f in NODE_SCHEMA.fields[2:]]
        return df.selectExpr(f"{name} as name", f"'{kind}' as type", *rest)

    def edge(df: DataFrame, source: str, rel: str, target: str) -> DataFrame:
        return df.selectExpr(f"{source} as source", f"'{rel}' as rel", f"{target} as target", "cast(null as string) as provenance", "cast(null as string) as metadata")

    customers = t["customer"].select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    suppliers = t["supplier"].select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    parts = t["part"].select("p_partkey", "p_size", "p_name", F.expr("replace(p_brand, 'Brand#', '')").alias("brand"))

    def owned() -> DataFrame:
        return t["orders"].select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(customers, "c_custkey")

    def placed() -> DataFrame:
        """Orders with their customers' nations and how many lines they have."""
        lines = t["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("cc"))
        return owned().join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "c_custkey", "n_nationkey", "n_regionkey", "cc")

    def hot() -> DataFrame:
        """Distinct hot lines, each with the next part of its order and its order, if there is one; whether it is the first with its part, and with its supplier."""
        lines = t["lineitem"].where("l_returnflag = 'R' AND l_quantity >= 30").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").repartition("l_orderkey").distinct()
        lines = lines.selectExpr("*", "lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as next")
        met = lines.join(owned(), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        of = "l_orderkey, c_custkey, n_nationkey, n_regionkey"
        first = [f"row_number() over (partition by {of}, {c} order by l_linenumber, l_partkey, l_suppkey) = 1 as {name}" for c, name in (("l_partkey", "new_part"), ("l_suppkey", "new_supplier"))]
        return met.selectExpr("l_orderkey", "c_custkey", "n_nationkey", "n_regionkey", "l_partkey", "l_suppkey", "next", *first)

    def nodes(orders: Callable[[], DataFrame] = placed) -> DataFrame:
        found = [
            node(t["region"], "'r' || r_regionkey", "package"),
            node(n, in_nation, "module", file=src),
            node(customers, f"{in_nation} || '.C' || c_custkey", "class", file=src),
            node(suppliers, f"{in_nation} || '.S' || s_suppkey", "interface", file=src),
            node(orders(), f"{in_nation} || '.C' || c_custkey || '.o' || o_orderkey", "method", file=src, line="1 + 10 * (o_orderkey % 1000)", end_line="1 + 10 * (o_orderkey % 1000) + 9", cc="cc"),
            node(spark.range(1), "'cat'", "package"),
            node(parts.select("brand").distinct(), "'cat.b' || brand", "module", file="'b' || brand || '.src'"),
            node(parts, "'cat.b' || brand || '.p' || p_partkey", "function", file="'b' || brand || '.src'", docstring="p_name", cc="p_size"),
        ]
        return reduce(DataFrame.union, found)

    def containment() -> DataFrame:
        found = [
            edge(n, "'r' || n_regionkey", "contains", in_nation),
            edge(customers, in_nation, "contains", f"{in_nation} || '.C' || c_custkey"),
            edge(suppliers, in_nation, "contains", f"{in_nation} || '.S' || s_suppkey"),
            edge(owned(), f"{in_nation} || '.C' || c_custkey", "contains", f"{in_nation} || '.C' || c_custkey || '.o' || o_orderkey"),
            edge(parts, "'cat.b' || brand", "contains", "'cat.b' || brand || '.p' || p_partkey"),
            edge(parts.select("brand").distinct(), "'cat'", "contains", "'cat.b' || brand"),
        ]
        return reduce(DataFrame.union, found)

    def relations() -> DataFrame:
        lines = once("lines", hot)
        known = lines.where("c_custkey is not null")
        order = f"{in_nation} || '.C' || c_custkey || '.o' || l_orderkey"
        part = parts.select("p_partkey", "brand").distinct()
        follows = lines.where("l_partkey <> next").select("l_partkey", "next").distinct()
        follows = follows.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("brand").alias("a")), "l_partkey").join(part.select(F.col("p_partkey").alias("next"), F.col("brand").alias("b")), "next")
        supplier = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.struct("n_nationkey", "n_regionkey").alias("s")).distinct()
        depends = known.where("new_supplier").join(supplier, "l_suppkey")
        trade = depends.where("n_nationkey <> s.n_nationkey").select("n_nationkey", "n_regionkey", "s").distinct()
        of_supplier = "'r' || s.n_regionkey || '.n' || s.n_nationkey"
        heirs = customers.join(customers.select(F.col("c_custkey").alias("d_custkey"), F.struct("n_nationkey", "n_regionkey").alias("d")), F.expr("d_custkey = cast(floor(c_custkey / 2) as bigint)")).where("c_custkey >= 1")
        found = [
            edge(known.where("new_part").join(part, F.col("l_partkey") == F.col("p_partkey")), order, "calls", "'cat.b' || brand || '.p' || p_partkey"),
            edge(depends, order, "depends_on", f"{of_supplier} || '.S' || l_suppkey"),
            edge(follows, "'cat.b' || a || '.p' || l_partkey", "calls", "'cat.b' || b || '.p' || next"),
            edge(trade, in_nation, "imports", of_supplier),
            edge(heirs, f"{in_nation} || '.C' || c_custkey", "inherits", "'r' || d.n_regionkey || '.n' || d.n_nationkey || '.C' || d_custkey"),
        ]
        return reduce(DataFrame.union, found)

    return {"nodes": nodes, "described": lambda: nodes(lambda: owned().withColumn("cc", F.lit(None))), "containment": containment, "relations": relations}
