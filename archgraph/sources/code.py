"""Source trees: files to graph, with targets resolved by joins.

Files are read and parsed by tasks; names are resolved over all
files at once by an equi-join on dotted suffixes.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.model import EDGE_SCHEMA, NODE_SCHEMA, Graph
from archgraph.operators.select import suffixes
from archgraph.sources import brace_code, python_code
from archgraph.sources.python_code import Extract

Extractor = Callable[[bytes, str, str], Extract]

REGISTRY: dict[str, Extractor] = {
    ".py": python_code.extract,
    **dict.fromkeys((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"), brace_code.javascript),
    **dict.fromkeys((".c", ".h", ".cpp", ".cc", ".cxx", ".cu", ".metal", ".hpp", ".hh", ".hxx", ".cuh"), brace_code.c_family),
    ".zig": brace_code.zig,
}
EXCLUDES = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", "build", "dist", "target", ".tox", ".mypy_cache", ".pytest_cache", ".zig-cache", "zig-out")
_EXTRACTED = "file string, kind string, name string, type string, line int, end_line int, docstring string, cc int, content_hash string, structure_hash string, metadata string, source string, rel string, target string, unresolved boolean"


def register(extension: str, extractor: Extractor) -> None:
    """Adds a language for all scans that start in this process."""
    REGISTRY[extension] = extractor


def module_name(path: str, packages: dict[str, str] | None = None) -> str:
    """The dotted module of a path: src/ goes, __init__ and index collapse, a folder with a package.json takes its name."""
    parts = path.split("/")
    for k in range(len(parts) - 1, -1, -1):
        name = (packages or {}).get("/".join(parts[:k]))
        if name:
            rest = parts[k:]
            prefix = [name.lstrip("@").replace("/", ".")]
            break
    else:
        rest, prefix = parts, []
    if len(rest) > 1 and rest[0] == "src":
        rest = rest[1:]
    stem, dot, _ = rest[-1].rpartition(".")
    rest = rest[:-1] if stem in ("__init__", "index") else [*rest[:-1], stem if dot else rest[-1]]
    return ".".join([*prefix, *filter(None, rest)])


def supported(path: Column, excludes: tuple[str, ...] = ()) -> Column:
    """Relative paths with a known extension, none of whose parts is hidden or excluded."""
    known = F.regexp_extract(path, r"(\.[^./]+)$", 1).isin(*REGISTRY)
    plain = [re.sub(r"([^\w*?-])", r"\\\1", x).replace("*", "[^/]*").replace("?", "[^/]") for x in (*EXCLUDES, *excludes) if "/" not in x]
    parts = "|".join(plain)
    ok = known & ~path.rlike(rf"(?:^|/)(?:{parts})(?:/|$)") & ~path.rlike(r"(?:^|/)\.[^/]")
    for x in excludes:
        if "/" in x:
            from archgraph.operators.select import glob

            ok = ok & ~glob(path, x)
    return ok


#: A file at the root of a tree with one pattern a line, # before comments.
IGNORE_FILE = ".archgraphignore"


def ignored(store: fs.FileSystem, base: str) -> tuple[str, ...]:
    if store.get_file_info(f"{base}/{IGNORE_FILE}").type != fs.FileType.File:
        return ()
    with store.open_input_file(f"{base}/{IGNORE_FILE}") as f:
        lines = [x.strip().rstrip("/") for x in f.read().decode(errors="replace").splitlines()]
    return tuple(x for x in lines if x and not x.startswith("#"))


def files(spark: SparkSession, root: str, excludes: tuple[str, ...] = ()) -> DataFrame:
    """(path relative to root, content) of the source files below root, without those that an ignore file there names.

    The driver lists the tree, tasks read it. Spark's own file sources leave out names that begin
    with an underscore, and so `__init__.py`.
    """
    from archgraph.store import arm

    arm(spark)
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"
    store, base = fs.FileSystem.from_uri(uri)
    base = base.rstrip("/")
    excludes = (*excludes, *ignored(store, base))
    found = [f.path[len(base) + 1 :] for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and os.path.splitext(f.path)[1] in REGISTRY]
    paths = spark.createDataFrame([(f,) for f in sorted(found)], "path string").where(supported(F.col("path"), excludes))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(f"{base.rstrip('/')}/{path}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return paths.repartition(max(1, min(len(found) // 16, 512))).mapInArrow(read, "path string, content binary")


def _rows(path: str, found: Extract) -> Iterator[dict]:
    for n in found.nodes:
        meta = dict(json.loads(n["metadata"])) if n.get("metadata") else {}
        if n.get("metrics"):
            meta["metrics"] = n["metrics"]
        yield {"file": path, "kind": "node", **{k: n.get(k) for k in ("name", "type", "line", "end_line", "docstring", "cc", "content_hash", "structure_hash")}, "metadata": json.dumps(meta) if meta else None}
    for s, r, t, open_ in found.edges:
        yield {"file": path, "kind": "edge", "source": s, "rel": r, "target": t, "unresolved": open_}


def extract(sources: DataFrame, packages: dict[str, str] | None = None) -> DataFrame:
    """Raw node and edge rows of files (path, content)."""
    from archgraph.store import arm

    arm(sources.sparkSession)
    registry = dict(REGISTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "boolean": pa.bool_()}
        schema = pa.schema([(x.split()[0], kinds.get(x.split()[1], pa.string())) for x in _EXTRACTED.split(", ")])
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = registry["." + path.rpartition(".")[2]](content, path, module_name(path, packages))
                yield pa.RecordBatch.from_pylist(list(_rows(path, found)), schema=schema)

    return sources.select("path", "content").mapInArrow(run, _EXTRACTED)


def _inherited(wanted: DataFrame, bases: DataFrame, names: DataFrame) -> DataFrame:
    """(source, rel, was, target) of calls of Class.method that the nearest base class above has, level by level."""
    from archgraph.store import cut

    bases = cut(bases.distinct(), "bases")
    methods = names.where("type = 'method'").select(F.col("name").alias("target"))
    seen = cut(wanted.select("source", "rel", F.col("target").alias("was"), "leaf", "klass").distinct(), "asked")
    left, out = seen, None
    while not left.isEmpty():
        up = left.join(bases, "klass").select("source", "rel", "was", "leaf", F.col("base").alias("klass")).distinct()
        up = cut(up.join(seen, ["source", "rel", "was", "klass"], "left_anti").select(*seen.columns), "asked")
        hit = cut(up.withColumn("target", F.concat_ws(".", "klass", "leaf")).join(methods, "target", "left_semi").groupBy("source", "rel", "was").agg(F.min("target").alias("target")), "hit")
        out = hit if out is None else out.union(hit)
        seen = seen.union(up)
        left = up.join(hit.select("source", "rel", "was"), ["source", "rel", "was"], "left_anti")
    return out if out is not None else wanted.select("source", "rel", F.col("target").alias("was"), "target").where("false")


#: Of skipped edges: what a category means.
HINTS = {
    "attribute_call": "A common method of a receiver whose type isn't known; seldom of interest.",
    "decorator": "The decorator comes from outside; what it decorates was scanned.",
    "external_call": "A call into a library; link it by hand if it matters.",
    "external_or_generated": "A dependency from outside, or generated; scan more if it is your own.",
    "missing_endpoint": "An end of the edge is no node.",
    "missing_scan_scope": "The target looks like your own but wasn't scanned; scan a wider folder.",
    "missing_source": "The edge begins at no node; the extractor may be at fault.",
    "unresolved_local": "A local name that wasn't resolved; a test of the extractor may be due.",
}
_COMMON = ("get", "add", "append", "extend", "update", "clear", "items", "join", "split", "strip", "replace", "format", "decode", "read", "write", "read_text", "write_text", "close", "exists", "match", "parse", "map", "run", "print", "info")


def diagnosis(skipped: DataFrame, samples: int = 10) -> DataFrame:
    """(category, count, hint, samples) of skipped edges; a report with the first few of each."""
    edge = F.format_string("%s -[%s]-> %s", "source", "rel", "target")
    ranked = skipped.withColumn("edge", edge).selectExpr("*", "row_number() over (partition by category order by edge) as nth")
    hint = F.element_at(F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair)), F.col("category"))
    return ranked.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list(F.when(F.col("nth") <= samples, F.col("edge")))).alias("samples")).select("category", "count", hint.alias("hint"), "samples")


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved edges, skipped edges with a category) of edges with `unresolved` targets.

    An exact name wins; else a dotted suffix that one node alone has; for calls of a bare name,
    the caller's module and class come first. Rank 1 is the best; a rank with several
    candidates falls through to the next.
    """
    names = nodes.select("name", "type")
    sure = edges.where("not unresolved").select("source", "rel", "target")
    open_ = edges.where("unresolved").select("source", "rel", "target").distinct()
    ends = names.select(F.col("name").alias("hit"), F.col("type").alias("kind"), F.explode(suffixes(F.col("name"))).alias("target"))
    met = open_.where("rel <> 'decorates'").join(ends, "target")
    module = F.expr("array_join(slice(split(source, '[.]'), 1, size(split(source, '[.]')) - 1), '.')")
    outer = F.expr("array_join(slice(split(source, '[.]'), 1, greatest(size(split(source, '[.]')) - 2, 0)), '.')")
    home = F.expr("array_join(slice(split(hit, '[.]'), 1, size(split(hit, '[.]')) - 1), '.')")
    type_like = F.col("target").rlike(r"^_*\p{Lu}")
    rank = (
        F.when(F.col("hit") == F.col("target"), 0)
        .when(F.col("rel") != "calls", 9)
        .when(((home == module) | (home == outer)) & (F.col("kind") == "function"), 1)
        .when(((home == module) | (home == outer)) & (F.col("kind") == "class") & type_like, 2)
        .when(home == module, 3)
        .when((F.col("kind") == "class") & type_like, 4)
        .when(F.col("kind") == "function", 5)
        .when(F.col("kind") == "class", 6)
        .otherwise(9)
    )
    per = met.withColumn("rank", rank).groupBy("source", "rel", "target", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("hit").alias("hit"))
    best = per.where("n = 1").groupBy("source", "rel", "target").agg(F.min_by("hit", "rank").alias("hit"))
    sure = sure.union(best.select("source", "rel", F.col("hit").alias("target")))
    # Calls of inherited methods: Class.method that only a base class has.
    left = open_.join(best, ["source", "rel", "target"], "left_anti")
    for end in ("source", "target"):
        sure_ok = sure.join(names.select(F.col("name").alias(end)), end, "left_semi").select("source", "rel", "target")
        lost = sure.join(names.select(F.col("name").alias(end)), end, "left_anti").select("source", "rel", "target")
        left, sure = left.union(lost), sure_ok
    bases = sure.where("rel = 'inherits'").select(F.col("source").alias("klass"), F.col("target").alias("base"))
    wanted = left.where("rel = 'calls'").select("source", "rel", "target", F.expr("array_join(slice(split(target, '[.]'), 1, size(split(target, '[.]')) - 1), '.')").alias("klass"), F.substring_index("target", ".", -1).alias("leaf"))
    single = _inherited(wanted, bases, names)
    sure = sure.union(single.select("source", "rel", "target")).distinct()
    left = left.join(single.select("source", "rel", F.col("was").alias("target")), ["source", "rel", "target"], "left_anti")
    roots = names.select(F.substring_index("name", ".", 1).alias("root")).distinct().withColumn("ours", F.lit(True))
    asked = left.withColumn("root", F.substring_index("target", ".", 1)).join(roots, "root", "left").withColumn("ours", F.coalesce("ours", F.lit(False)))
    asked = asked.join(names.select(F.col("name").alias("source"), F.lit(True).alias("begins")), "source", "left")
    target, dotted = F.col("target"), F.col("target").contains(".")
    category = (
        F.when(F.col("rel") == "decorates", "decorator").when(F.col("begins").isNull(), "missing_source")
        .when(dotted & (F.col("rel") == "calls") & F.substring_index(target, ".", -1).isin(*_COMMON), "attribute_call").when(F.col("ours"), "missing_scan_scope")
        .when(F.col("rel") != "calls", "external_or_generated").when(~dotted, F.when(target.rlike(r"^\p{Lu}"), "external_call").otherwise("unresolved_local"))
        .when(target.rlike(r"^[^.]*[.]\p{Lu}") | target.rlike(r"^\p{Ll}"), "external_call").otherwise("unresolved_local")
    )
    return sure, asked.select("source", "rel", "target", category.alias("category"))


def prune_packages(g: Graph) -> Graph:
    """Without packages that a scan made for modules below them and that hold nothing any more, level by level."""
    from archgraph.store import cut

    while True:
        made = g.nodes.where("type = 'package' and file is null and provenance = 'scan'").select("name")
        empty = cut(made.join(g.edges.where("rel = 'contains'").select(F.col("source").alias("name")), "name", "left_anti"), "empty")
        if empty.isEmpty():
            return g
        g = g.remove(empty)
        g = Graph(cut(g.nodes.select(NODE_SCHEMA.fieldNames()), "nodes"), cut(g.edges.select(EDGE_SCHEMA.fieldNames()), "edges"))


def orphans(before: Graph, after: Graph) -> DataFrame:
    """(source, rel, target, reason): edges made by hand that a rescan dropped because an end went."""
    by_hand = before.edges.where("provenance is null or provenance <> 'scan'").select("source", "rel", "target")
    lost = by_hand.join(after.edges.select("source", "rel", "target"), ["source", "rel", "target"], "left_anti")
    names = after.nodes.select(F.col("name").alias("source"), F.lit(True).alias("there"))
    return lost.join(names, "source", "left").select("source", "rel", "target", F.when(F.col("there").isNull(), "source node removed").otherwise("target node removed").alias("reason"))


def stamp_fans(g: Graph) -> Graph:
    """Each node's fan_in and fan_out in its metadata."""
    from archgraph.operators.analytics import fan_in_out

    fans = fan_in_out(g).select("name", F.to_json(F.struct("fan_in", "fan_out")).alias("fans"))
    kind = "map<string,string>"
    merged = F.to_json(F.map_concat(F.map_filter(F.coalesce(F.from_json("metadata", kind), F.expr("map()").cast(kind)), lambda k, _: ~k.isin("fan_in", "fan_out")), F.from_json("fans", kind)))
    nodes = g.nodes.join(fans, "name", "left").withColumn("metadata", F.when(F.col("fans").isNotNull(), merged).otherwise(F.col("metadata")))
    return Graph(nodes.select(NODE_SCHEMA.fieldNames()), g.edges)


def scan(sources: DataFrame, packages: dict[str, str] | None = None, into: Graph | None = None, gone: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """The graph of source files, and the edges that had no target.

    `into`: a graph of earlier scans. What it holds of the scanned files by provenance `scan` is
    replaced; nodes and edges made by hand stay, edges whose ends went are dropped (see `orphans`).
    `gone`: paths of files that are no more; what a scan made of them goes, and packages left empty.
    """
    from archgraph.store import cut

    raw = cut(extract(sources, packages), "extracted")
    made = raw.where("kind = 'node'").dropDuplicates(["name"]).withColumn("entry_point", F.lit(None).cast("boolean")).withColumn("provenance", F.lit("scan")).select(NODE_SCHEMA.fieldNames())
    edges = raw.where("kind = 'edge'").select("source", "rel", "target", "unresolved")
    modules = made.where("type in ('module', 'package')").select("name")
    above = modules.select("name", F.explode(F.expr("transform(sequence(1, size(split(name, '[.]'))), i -> array_join(slice(split(name, '[.]'), 1, i), '.'))")).alias("p"))
    packages_ = above.where("p <> name").select(F.col("p").alias("name")).distinct().join(made.select("name"), "name", "left_anti")
    made = made.unionByName(packages_.select("name", F.lit("package").alias("type"), F.lit("scan").alias("provenance")), allowMissingColumns=True)
    chain = modules.union(packages_).where("name like '%.%'").distinct()
    tree = chain.select(F.expr("array_join(slice(split(name, '[.]'), 1, size(split(name, '[.]')) - 1), '.')").alias("source"), F.lit("contains").alias("rel"), F.col("name").alias("target"), F.lit(False).alias("unresolved"))
    if into is not None:
        seen = sources.select(F.col("path").alias("file"))
        seen = (seen if gone is None else seen.union(gone.select("path"))).distinct()
        ours = F.coalesce(F.col("provenance") == "scan", F.lit(False))
        kept = into.nodes.where(~ours).union(into.nodes.where(ours).join(seen, "file", "left_anti").select(*into.nodes.columns))
        kept = kept.join(made.select("name"), "name", "left_anti").select(NODE_SCHEMA.fieldNames())
        stale = into.nodes.where(ours).join(seen, "file", "left_semi").select(F.col("name").alias("source"))
        old = into.edges.where(~F.coalesce(F.col("provenance") == "scan", F.lit(False))).union(into.edges.where(F.coalesce(F.col("provenance") == "scan", F.lit(False))).join(stale, "source", "left_anti").select(*into.edges.columns))
        nodes = kept.unionByName(made)
    else:
        nodes, old = made, None
    nodes = cut(nodes, "nodes")
    sure, skipped = resolve_edges(nodes, edges.union(tree))
    out = sure.select("source", "rel", "target", F.lit("scan").alias("provenance"), F.lit(None).cast("string").alias("metadata"))
    if old is not None:
        names = nodes.select("name")
        old = old.join(names.withColumnRenamed("name", "source"), "source", "left_semi").join(names.withColumnRenamed("name", "target"), "target", "left_semi")
        out = out.unionByName(old.select(EDGE_SCHEMA.fieldNames()).join(out, ["source", "rel", "target"], "left_anti"))
    found = Graph(nodes, cut(out, "edges"))
    return (found if gone is None else prune_packages(found)), skipped
