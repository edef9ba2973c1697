"""Near-duplicate documents: MinHash signatures, joined coordinate by coordinate.

1. `sketch`: a document's set is its distinct 3-word shingles; its signature holds K minima.
   Documents with equal sets form a class at once; only the class's smallest id goes on.
2. `postings`: a document is posted under each (coordinate, value) pair. A pair of documents
   at or above the threshold agrees on at least T of the K coordinates (but for a chance of
   under 1e-6 at the threshold itself), so it shares one of the K - T + 1 rarest pairs of
   both: only that prefix is merged, the rest is skipped. Values that nobody else has come
   first in that order, so an ordinary document posts nothing.
3. `link`: within a posting list, members are compared with one leader a round and linked
   ones merge into a component, so a group of thousands of copies costs as many comparisons
   as it has members. What still shares a list but no component after ROUNDS leaders is
   compared exactly. In lists of up to SHORT such documents, collisions are counted over the
   merged prefixes, and pairs go on that can still reach T with what their prefixes skip.
   Documents of longer lists meet through their rarest shingles instead (`rare_pairs`), as
   all that are similar enough must share one of those: no pair of a long list is formed that
   shares common values alone. Candidates are held to T equal coordinates, the skipped ones
   included, and confirmed on their full sets.

Nulls: a null text is an empty document; empty documents link with nothing. Rows with a null
doc_id are returned with component_id null and kept true. Rows that repeat a doc_id are one
document, whose set is the least of theirs by (size, digest), empty ones left out; each row is
returned with its own n_shingles and the document's component. Ties: of a component the
smallest doc_id stays. Texts are read whole, however long; a set is held by one task at a
time. An empty table gives no row. Other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm.store import arm, cut, scratch, table
from archgraph.llm.text import Words, chunks, list_array, mix, shingle_sets, signed

K, T, ROUNDS = 64, 38, 3
PERCENT = 85
#: A posting list with more documents to compare than this is left to `rare_pairs`; either way finds all pairs.
SHORT = 32
_rng = np.random.default_rng(85)
_A = _rng.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 1 << 63, K, dtype=np.uint64)


def signatures(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """K minima of each set; the sets lie one after the other in flat."""
    out = np.empty((len(begins), K), np.int32)
    for i in range(K):
        v = ((flat * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(v, begins).view(np.int32)
    return out


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the sets, two digests of each, and all sets one after the other."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    sums = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        begins = (np.cumsum(size) - size)[full]
        sums[0, full] = np.add.reduceat(mix(flat ^ _A[0]), begins)
        sums[1, full] = np.add.reduceat(mix(flat + _B[0]), begins)
    return size, signed(sums[0]), signed(sums[1]), flat


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            sets = shingle_sets(Words(part.column("text"), lower=True))
            size, c1, c2, flat = _digests(sets)
            sig_bounds = np.concatenate([[0], np.cumsum(np.where(size > 0, K, 0))])
            full = np.flatnonzero(size)
            sig = signatures(flat, (np.cumsum(size) - size)[full]) if len(full) else np.zeros((0, K), np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size), pa.array(c1), pa.array(c2), list_array(sig.ravel(), sig_bounds, pa.int32())],
                names=["doc_id", "n_shingles", "c1", "c2", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts that have the wanted digests."""
    for batch in batches:
        for part in chunks(batch):
            sets = shingle_sets(Words(part.column("text"), lower=True))
            _, c1, c2, _ = _digests(sets)
            mine = np.flatnonzero((c1 == part.column("c1").to_numpy(zero_copy_only=False)) & (c2 == part.column("c2").to_numpy(zero_copy_only=False)))
            rows = part.take(pa.array(mine))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n"), rows.column("sig"), pa.array([sets[i].tobytes() for i in mine], pa.binary())], names=["doc_id", "n", "sig", "shingles"])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), list_array(np.concatenate(sets) if sets else np.zeros(0, np.int64), bounds, pa.int64())], names=["doc_id", "n", "s"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = 0
            if 100 * min(len(a), len(b)) >= PERCENT * max(len(a), len(b)):
                m = np.concatenate([a, b])
                m.sort()
                both = int((m[1:] == m[:-1]).sum())
            keep.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])


def sketch(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch, "doc_id long, n_shingles long, c1 long, c2 long, sig array<int>")


def prefix_postings(reps: DataFrame) -> DataFrame:
    """(token, doc_id, n, rest) of the prefixes: of the tokens that a document shares, all but T - 1 of the commonest. rest: tokens behind this one."""
    posts = reps.select("doc_id", "n", F.posexplode("sig").alias("i", "v")).select(F.xxhash64("i", "v").alias("token"), "doc_id", "n")
    often = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = posts.join(often, "token").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))  # at most K each
    prefix = mine.where(F.size("t") >= T).select("doc_id", "n", F.size("t").alias("all"), F.posexplode(F.expr(f"slice(t, 1, size(t) - {T - 1})")).alias("i", "t"))
    return prefix.select("t.token", "doc_id", "n", (F.col("all") - 1 - F.col("i")).cast("int").alias("rest"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, component): smallest vertex reachable, for all that have an edge; edges(a, b)."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.doc_id).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels.doc_id == near.a).select("doc_id", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("doc_id").alias("via"), F.col("component").alias("beyond"))
        new = cut(met.join(jump, "via").select("doc_id", "was", F.least("via", "beyond").alias("component")), "labels")
        labels = new.select("doc_id", "component")
        if new.where("was <> component").isEmpty():
            return labels


def _agreement() -> Column:
    return F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def verify(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """pairs(a, b) with linked: at least T equal coordinates, and the full sets similar enough."""
    sig = candidates.select("doc_id", "sig")
    sets = candidates.select("doc_id", "shingles")
    one = sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"))
    two = sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"))
    near = pairs.join(one, "a").join(two, "b").where(_agreement() >= T).select("a", "b")
    near = near.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
    return near.mapInArrow(_confirm, "a long, b long, linked boolean")


def _close(n: str, m: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return PERCENT * F.greatest(n, m) <= 100 * F.least(n, m)


def led_pairs(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Each member of a list with the list's leader, where they aren't linked yet."""
    met = members.join(lists, "token").where((F.col("component") != F.col("leader.component")) & _close("n", "leader.n"))
    return met.select(F.least("doc_id", "leader.doc_id").alias("a"), F.greatest("doc_id", "leader.doc_id").alias("b")).distinct()


def counted_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components in lists of at most SHORT members, whose collisions can come to T.

    All lists of a pair that isn't linked are here, but for longer ones, which `rare_pairs` takes
    care of. Behind the last list that both are in, they share at most what both skip.
    """
    x = members.select("token", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("component").alias("c_a"))
    y = members.select("token", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("component").alias("c_b"))
    met = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _close("n_a", "n_b"))
    counted = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.least(F.min("rest_a"), F.min("rest_b")).alias("rest"))
    return counted.where(F.col("shared") + F.col("rest") >= T).select("a", "b")


def rare_pairs(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles, among all members.

    With shingles in one order, the rarest first, sets of n <= m that are similar enough have
    their first common one among the first n - 2p/(1+p) n + 1 of the smaller set and the first
    m - p m + 1 of the larger, and as many as needed can still follow it.
    """
    mine = candidates.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", "shingles").mapInArrow(_numbers, "doc_id long, n long, s array<long>")
    each = mine.select("doc_id", "n", F.explode("s").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = each.join(often, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("t"))  # at most the document's own shingles
    need = lambda n: F.ceil(F.lit(PERCENT) * n / 100)
    ranked = order.select("doc_id", "n", (F.col("n") - F.size("t")).alias("own"), F.posexplode("t").alias("i", "t")).select("doc_id", "n", F.col("t.s").alias("s"), (F.col("own") + F.col("i")).alias("at"))
    label = members.groupBy("doc_id").agg(F.first("component").alias("component"))
    prefix = cut(ranked.where(F.col("at") <= F.col("n") - need(F.col("n"))).join(label, "doc_id"), "rare")
    x, y = prefix.alias("x"), prefix.alias("y")
    size = F.col("x.n") + F.col("y.n")
    both = F.ceil(F.lit(PERCENT) * size / (100 + PERCENT))
    first = (F.struct("x.n", "x.doc_id") < F.struct("y.n", "y.doc_id")) & (F.col("x.at") <= F.col("x.n") - F.ceil(2 * F.lit(PERCENT) * F.col("x.n") / (100 + PERCENT)))
    met = x.join(y, F.col("x.s") == F.col("y.s")).where(first & (F.col("x.component") != F.col("y.component")) & _close("x.n", "y.n") & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= both))
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def link(postings: DataFrame, candidates: DataFrame) -> DataFrame | None:
    """Components (doc_id, component) of the candidates that have a link; None if there are none."""
    links: DataFrame | None = None
    seen: DataFrame | None = None
    labels: DataFrame | None = None
    for r in range(ROUNDS + 1):
        if labels is None:
            members = postings.withColumn("component", F.col("doc_id"))
        else:
            members = postings.join(labels, "doc_id", "left").select("token", "doc_id", "n", "rest", F.coalesce("component", "doc_id").alias("component"))
        lists = members.groupBy("token").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.min_by(F.struct("doc_id", "n", "component"), F.xxhash64("doc_id", F.lit(r))).alias("leader")
        ).where("lo <> hi")
        if r < ROUNDS:
            pairs = led_pairs(members, lists)
        else:
            open_ = cut(members.join(lists.select("token", "size"), "token"), "open")
            pairs = counted_pairs(open_.where(f"size <= {SHORT}"))
            long = open_.where(f"size > {SHORT}")
            if not long.isEmpty():
                pairs = pairs.union(rare_pairs(long, candidates)).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        if pairs.isEmpty():
            continue  # other leaders, and the last step, may still bring pairs that weren't compared
        found = cut(verify(pairs, candidates).where("linked").select("a", "b"), "links")
        seen = pairs if seen is None else seen.union(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)
    return None if labels is None else cut(labels, "linked")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The sketches, (doc_id, rep) of documents in classes of equal sets, and (doc_id, component) of linked classes."""
    sk = cut(sketch(docs), "sketch")
    rows = sk.where("n_shingles > 0 and doc_id is not null").withColumnRenamed("n_shingles", "n")
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "c1", "c2")).alias("own")).where("k > 1").drop("k")
    full = rows.join(repeated, "doc_id", "left").where("own is null or (own.n = n and own.c1 = c1 and own.c2 = c2)").drop("own")
    classes = full.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    rep = cut(full.select("doc_id", "n", "c1", "c2").join(classes, ["n", "c1", "c2"]).select("doc_id", "rep").distinct(), "classes")
    reps = full.select("doc_id", "n", "sig").join(rep.where("rep <> doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    posts = cut(prefix_postings(reps), "postings")
    wanted = posts.select("doc_id").distinct().join(full, "doc_id").dropDuplicates(["doc_id"])
    with_sets = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id").mapInArrow(_sets, "doc_id long, n long, sig array<int>, shingles binary")
    labels = link(posts, cut(with_sets.dropDuplicates(["doc_id"]), "candidates"))
    return sk, rep, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    arm(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        sk, rep, labels = linked(docs)
        for written in (sk, rep) if labels is None else (sk, rep, labels):
            keep(written)
    out = sk.select("doc_id", "n_shingles").join(rep, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    if labels is not None:
        out = out.join(labels.select(F.col("doc_id").alias("rep"), "component"), "rep", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), g AS (SELECT doc_id, unnest(s) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT r.doc_id, e2.b FROM r JOIN e2 ON e2.a = r.other
), c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
