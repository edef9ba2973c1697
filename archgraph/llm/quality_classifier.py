"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Trees are boosted on a bounded sample of labelled rows; every path from a root to a node is a
conjunctive rule. A logistic model over the rules is fitted with an L1 penalty, which leaves a
few dozen of them. These are compiled into Spark column expressions, so that scoring is a
projection over the statistics, which one vectorised pass takes from whole texts.

Labels come from rows whose crc32(doc_id as text) mod 5 is not 0, at most SAMPLE of them, those
least by a hash of doc_id. doc_id, lang, source and labels are never inputs of a score.

Nulls and edges: a null text is an empty one and is scored; rows with a null label are not
learned from; with no labels, or labels of one kind, every score is their (smoothed) rate. Rows
that repeat a doc_id are scored each for itself; the model learns from one of them, that of the
least text, and of repeated labels from the highest. Equal texts (ties) score alike; a score at
the threshold is accepted. Texts are measured whole, however long. An empty table gives no row.
Columns of docs may have any names; they are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.stats import measure
from archgraph.llm.store import arm, plain, table
from archgraph.llm.text import chunks

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 30, 3, 32, 0.3, 10
THRESHOLD = 0.3
FEATURES = ["log_words", "word_length", "symbols", "lone", "upper", "shouts", "digits", "stops", "ends", "dup_lines", "repeats", "stutters", "line_words", "other_bytes"]


def features(column: pa.Array) -> np.ndarray:
    """One row per text, one column per name in FEATURES."""
    _, s = measure(column)
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_lone"] / words, s["n_upper"] / np.maximum(s["n_alpha"], 1),
        s["n_shouts"] / words, s["n_digits"] / chars, s["n_stops"] / words, s["n_ends"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words,
        s["n_stutters"] / words, s["n_words"] / lines, 1 - s["n_alpha"] / np.maximum(s["n_bytes"], 1),
    ]).round(6)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.schema.get_field_index("text")
        for part in chunks(batch):
            x = features(part.column(text))
            rest = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1]))], names=[*(n for n, _ in rest), *(f"__{f}" for f in FEATURES)])


def with_features(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, followed by the statistics."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, *(T.StructField(f"__{f}", T.DoubleType()) for f in FEATURES)])
    return docs.select(*(f.name for f in rest), F.col("text").cast("string").alias("text")).mapInArrow(_measured, schema)


#: A rule: (feature, is it over, threshold) each, all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, cuts: list[np.ndarray], codes: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, out: list[Rule], score: np.ndarray) -> None:
    """One tree of DEPTH levels by gain of gradients; adds its paths to out and its leaves to score."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST:
        for f in range(x.shape[1]):
            k = codes[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(k, weights=w, minlength=len(cuts[f]) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    _, f, at = best
    if f < 0:
        score[rows] -= RATE * g / (h + 1)
        return
    under = codes[rows, f] <= at
    for over, mine in ((False, rows[under]), (True, rows[~under])):
        rule = (*path, (f, over, float(cuts[f][at])))
        out.append(rule)
        _grow(x, cuts, codes, grad, hess, mine, rule, out, score)


def paths(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    score = np.zeros(len(y))
    out: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        _grow(x, cuts, codes, p - y, p * (1 - p), np.arange(len(y)), (), out, score)
    return list(dict.fromkeys(out))


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for f, over, t in rule:
            out[:, j] *= (x[:, f] > t) if over else (x[:, f] <= t)
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = a.shape
    w = np.zeros(m + 1)
    full = np.column_stack([np.ones(n), a])
    v = np.random.default_rng(0).normal(size=m + 1)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / float(v @ (full.T @ (full @ v))) * 0.95
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(full @ z)))
        new = z - step * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            test = F.lit(True)
            for f, over, t in rule:
                c = F.col(f"__{FEATURES[f]}")
                test = test & ((c > t) if over else (c <= t))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from trees, weights from the lasso; the penalty is chosen on every fifth row."""
    if len(y) < 4 * LEAST or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(float(np.log(rate / (1 - rate))), ())
    rules = paths(x, y)
    a = holds(rules, x)
    aside = np.arange(len(y)) % 5 == 4
    loss = []
    penalties = (0.02, 0.008, 0.003, 0.001)
    for penalty in penalties:
        bias, w = lasso(a[~aside], y[~aside], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[aside] @ w + bias))), 1e-6, 1 - 1e-6)
        loss.append(-(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).mean())
    bias, w = lasso(a, y, penalties[int(np.argmin(loss))])
    return Model(bias, tuple((round(float(k), 6), r) for k, r in zip(w, rules, strict=True) if abs(k) > 1e-6))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> Model:
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("__y"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")  # SAMPLE bounds it
    known = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__y").alias("__y"))  # one row of a repeated doc_id, so SAMPLE bounds these too
    rows = with_features(known).toPandas().sort_values("doc_id", kind="stable")
    x = rows[[f"__{f}" for f in FEATURES]].to_numpy(float)
    return fit(x, rows["__y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    arm(docs.sparkSession)
    model = train(docs, labels)
    scored = with_features(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns."""
    arm(docs.sparkSession)
    model = train(docs, labels)
    rows, _, text = plain(docs)
    return with_features(rows.withColumn("text", F.col(f"c{text}"))).where(model.score() >= THRESHOLD).select(*rows.columns).toDF(*docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
