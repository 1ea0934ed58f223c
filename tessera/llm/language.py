"""Language identification by nearest TF-IDF centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import by_value, id_remainder, small_batches, table
from tessera.llm.ngrams import letters_only, ngram_slots

by_value(__name__)

BITS = 13
LONGEST = 3


def _counts(text: str) -> np.ndarray:
    return np.bincount(ngram_slots(text, LONGEST, BITS), minlength=2**BITS)


class Centroids:
    """Unit TF-IDF centroids, ``clusters`` a language at most, with a smallest cosine each."""

    def __init__(self, counts: np.ndarray, langs: list[str], clusters: int, reject: float) -> None:
        seen = (counts > 0).sum(axis=0)
        self.idf = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
        x = self.vectors(counts)
        self.rows = len(langs)
        self.langs, centres, owner, floors = sorted(set(langs)), [], [], []
        of = np.array([self.langs.index(v) for v in langs])
        for k in range(len(self.langs)):
            own = x[of == k]
            c = self._cluster(own, clusters)
            nearest = own @ c.T
            for j in range(len(c)):
                mine = nearest[nearest.argmax(axis=1) == j, j]
                floors.append(np.quantile(mine, reject) if len(mine) else 0.0)
            centres.append(c)
            owner += [k] * len(c)
        self.centres, self.owner, self.floors = np.vstack(centres), np.array(owner), np.array(floors)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float32)) * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)

    @staticmethod
    def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
        """Spherical k-means; the first centre is the mean, each next one the row farthest from all."""
        c = [x.mean(axis=0)]
        while len(c) < min(k, len(x)):
            c.append(x[(x @ np.array(c).T).max(axis=1).argmin()])
        c = np.array(c)
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        return c.astype(np.float32)

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """Language, probability-like score, and whether the nearest centroid is too far, of non-empty texts."""
        cos = self.vectors(np.array([_counts(t) for t in texts])) @ self.centres.T
        best = np.array([cos[:, self.owner == k].max(axis=1) for k in range(len(self.langs))]).T
        odds = np.exp(30 * (best - best.max(axis=1, keepdims=True)))
        near, far = cos.argmax(axis=1), cos.max(axis=1)
        return [
            (self.langs[self.owner[j]], float(o.max() / o.sum()), bool(f < self.floors[j]))
            for j, o, f in zip(near, odds, far, strict=True)
        ]


def fit_centroids(
    labelled: DataFrame, max_rows: int = 3000, clusters: int = 3, reject: float = 0.002
) -> Centroids | None:
    """Learn from ``labelled(id, text, lang)``: at most ``max_rows`` rows in all, of the ``max_rows`` most frequent languages, the
    same number for each, chosen by a hash of id and text. Rows with a null text or lang are passed over; repeated rows
    are rows. N-grams are counted on the executors. None if nothing can be learnt.

    Rows whose hash is above a limit that leaves half as many again as wanted go before the rest is ranked, so no task
    ranks all rows of a language.
    """
    spark = labelled.sparkSession
    labelled = labelled.where("lang is not null and text is not null").withColumn("hash", F.xxhash64("id", "text"))
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_rows).collect()
    if not counts:
        return None
    each = max(max_rows // len(counts), 1)
    limits = [(lang, int(-(2**63) + min((1.5 * each + 30) / n, 1) * (2**64 - 2048))) for lang, n in counts]
    limits = spark.createDataFrame(limits, "lang string, most bigint")
    few = labelled.join(F.broadcast(limits), "lang").where("hash <= most").select("id", "text", "lang", "hash")
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))).where(F.col("rank") <= each)
    schema = pa.schema([("lang", pa.string()), ("rank", pa.int32()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def count(batches):
        for b in batches:
            for lang, rank, text in zip(b["lang"].to_pylist(), b["rank"].to_pylist(), b["text"], strict=True):
                bare = letters_only(text.as_py())
                if bare:
                    n = _counts(bare)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": [lang], "rank": [rank], "at": [at.astype(np.int32).tolist()], "n": [n[at].astype(np.int32).tolist()]}, schema=schema
                    )

    got = few.select("lang", "rank", "text").mapInArrow(count, "lang string, rank int, at array<int>, n array<int>").toArrow()
    got = got.sort_by([("lang", "ascending"), ("rank", "ascending")])
    if not got.num_rows:
        return None
    counts = np.zeros((got.num_rows, 2**BITS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        counts[i, at.values.to_numpy()] = n.values.to_numpy()
    return Centroids(counts, got["lang"].to_pylist(), clusters, reject)


def identify(docs: DataFrame, model: Centroids | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row.

    ``lang_pred`` is the nearest centroid's language; ``und`` with score 0 if the text is null or has no
    letter, or nothing was learnt. ``rejected`` says that the nearest centroid is farther than nearly all
    texts it was learnt from. Whole texts count, however long; repeated rows get equal results. Other columns are
    ignored; no documents give no rows. Languages that are equally near go by name.
    """

    def run(batches):
        for b in batches:
            bare = [letters_only(t.as_py() or "") for t in b["text"]]
            out = [("und", 0.0, True)] * len(bare)
            if model:
                at = [i for i, t in enumerate(bare) if t]
                for lo in range(0, len(at), 200):
                    some = at[lo : lo + 200]
                    for i, p in zip(some, model.predict([bare[i] for i in some]), strict=True):
                        out[i] = p
            lang, score, far = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    train = docs.where(id_remainder(F.col("doc_id"), 5) != 0)
    model = fit_centroids(train.select(F.col("doc_id").alias("id"), "text", "lang"))
    out = identify(docs, model)
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
