"""Quality classifier: naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_value, id_remainder, small_batches, table
from tessera.llm.ngrams import ngram_slots

by_value(__name__)

BITS = 16
LONGEST = 3


def indicators(text: str) -> np.ndarray:
    """Slots of the n-grams that occur in the text, each once, ascending. Case counts."""
    seen = np.zeros(2**BITS, dtype=bool)
    seen[ngram_slots(text, LONGEST, BITS)] = True
    return np.flatnonzero(seen).astype(np.uint16)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(2**BITS, alpha), np.full(2**BITS, alpha)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0):
    """Weights and bias of the linear L1-hinge machine; each row's dual variable lies in [0, its cost]."""
    w, bias, alpha = np.zeros(2**BITS), 0.0, np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


class NaiveBayesSupportVectors:
    """Indicators scaled by log-count ratios and to unit length, a hinge-loss machine, a logistic scale.

    A fifth of the rows is kept from the machine and fits the scale of its margins.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = 12, c: float = 4.0) -> None:
        self.rows = len(rows)
        y = np.where(labels > 0, 1.0, -1.0)
        self.weights, self.ratio = np.zeros(2**BITS), np.zeros(2**BITS)
        self.bias, self.a, self.b = 0.0, 1.0, 0.0
        if not len(y) or abs(y.sum()) == len(y):  # one class: a constant
            self.b = 0.0 if not len(y) else 2.0 * y[0]
            return
        held = np.arange(len(y)) % 5 == 0
        if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
            held[:] = False
        fit = np.flatnonzero(~held)
        self.ratio = log_count_ratio([rows[i] for i in fit], y[fit])
        scaled = [self._values(rows[i]) for i in fit]
        share = {s: len(fit) / (2 * max((y[fit] == s).sum(), 1)) for s in (1.0, -1.0)}
        cost = np.array([c * share[s] for s in y[fit]])
        w, self.bias = dual_coordinate_descent([rows[i] for i in fit], scaled, y[fit], cost, epochs)
        self.weights = w * self.ratio
        to = np.flatnonzero(held) if held.any() else fit
        m, t = np.array([self.margin(rows[i]) for i in to]), (y[to] > 0).astype(float)
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps for the logistic scale, slightly regularised
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            g = np.array([(p - t) @ m + 0.01 * (a - 1), (p - t).sum() + 0.01 * b])
            v = p * (1 - p)
            h = np.array([[v @ (m * m) + 0.01, v @ m], [v @ m, v.sum() + 0.01]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if abs(step).max() < 1e-6:
                break
        self.a, self.b = (a, b) if a > 0 else (1.0, 0.0)

    def _values(self, x: np.ndarray) -> np.ndarray:
        v = self.ratio[x]
        return v / max(np.sqrt(v @ v), 1e-9) if len(v) else v

    def margin(self, x: np.ndarray) -> float:
        v = self.ratio[x]
        length = max(np.sqrt(v @ v), 1e-9) if len(v) else 1.0
        return float(self.weights[x].sum() / length + self.bias)

    def probability(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30))))


def fit_quality(labelled: DataFrame, labels: DataFrame, max_rows: int = 6000) -> NaiveBayesSupportVectors:
    """Learn from texts ``labelled(id, text)`` and ``labels(id, label)``: at most ``max_rows`` labelled rows,
    chosen by a hash of the id. Ids are of any type; null labels and ids are passed over, a null text is empty, repeated
    rows are rows. Indicators are found on the executors; only their slots are collected."""
    few = labels.where("label is not null and id is not null").orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    few = labelled.join(F.broadcast(few), "id").select(F.xxhash64("id").alias("h"), F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    few = few.withColumn("t", F.xxhash64("text")).orderBy("h", "label", "t").limit(max_rows)  # ids may repeat
    schema = pa.schema([("h", pa.int64()), ("t", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            for h, t, label, text in zip(b["h"], b["t"], b["label"], b["text"], strict=True):
                x = indicators(text.as_py())
                yield pa.RecordBatch.from_pydict({"h": [h.as_py()], "t": [t.as_py()], "label": [label.as_py()], "x": [x.astype(np.int32)]}, schema=schema)

    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = few.select("h", "t", "label", "text").repartition(parts).mapInArrow(run, "h bigint, t bigint, label int, x array<int>").toArrow()
    got = got.sort_by([("h", "ascending"), ("label", "ascending"), ("t", "ascending")])
    rows = [x.values.to_numpy().astype(np.uint16) for x in got["x"]]
    return NaiveBayesSupportVectors(rows, got["label"].to_numpy())


def score_quality(docs: DataFrame, model: NaiveBayesSupportVectors, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher: the label 1 is likelier) for every row and whole text.

    A null text counts as empty; an empty text has no n-gram and gets the machine's bias. With no labels, or
    labels of one class, all rows get one score. Texts of any length count whole; repeated rows get equal scores; no
    documents give no rows. All columns of ``docs`` are kept, but for one named ``quality_score``, which is replaced.
    """

    def run(batches):
        for b in batches:
            score = [model.probability(indicators(t.as_py() or "")) for t in b[text_col]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*b.schema.names, "quality_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    rest = StructType([f for f in docs.schema if f.name != "quality_score"])
    schema = StructType([*rest, StructField("quality_score", DoubleType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in rest]).mapInArrow(run, schema)


def fit_on(spark, docs: DataFrame, sf_dir: str) -> NaiveBayesSupportVectors:
    """The model that the query and the pipeline use: labels with crc32 of the id modulo 3 other than 1."""
    labels = table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 3) != 1)
    return fit_quality(
        docs.select(F.col("doc_id").alias("id"), "text"),
        labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")),
    )


def op10_quality(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_quality(docs, fit_on(spark, docs, sf_dir))
    return got.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )
