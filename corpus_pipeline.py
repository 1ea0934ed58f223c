"""Corpus preparation: quality filter, line dedup, near duplicates, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fresh, keyed, small_batches, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.jaccard import jaccard_components
from tessera.llm.lines import drop_lines, near_duplicate_lines
from tessera.llm.mixing import mix
from tessera.llm.quality import fit_on, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which the classifier gives the label 1 at least even odds; empty and null texts have odds too.

    Texts of any length count whole, repeated rows share their fate, further columns stay, no documents give no rows.
    """
    small_batches(spark)
    mark = fresh(docs.columns, "_score")
    scored = score_quality(docs.select(F.struct(*docs.columns).alias("row"), "text"), fit_on(spark, docs, sf_dir))
    return scored.withColumnRenamed("quality_score", mark).where(F.col(mark) >= 0.5).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that near-equal an earlier one; one that had only such lines goes.

    ``n_chars`` is counted anew, 0 for null. Null and empty texts stay; rows that repeat an id and text lose the same lines
    and stay for the next stage; lines of any length count whole.
    """
    out = drop_lines(docs, near_duplicate_lines(docs))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle similarity 0.8, that of the smallest id (and then the smallest
    hash of its text).

    Rows that repeat an id and text stay once; rows of one id with different texts are documents of their own; rows
    with a null id stay, as do empty texts. Texts of any length count whole.
    """
    scratch = Scratch(spark)
    linked = scratch.write(jaccard_components(docs, k=5, percent=80).where("doc_id is not null"))
    the_id, the_key = fresh(docs.columns, "_id"), fresh(docs.columns, "_key")
    place = [F.col("doc_id").alias(the_id), F.col("text_key").alias(the_key)]
    gone = linked.where("component_id <> doc_id or first_key <> text_key").select(*place).distinct()
    again = linked.groupBy("doc_id", "text_key").count().where("count > 1").select(*place)
    named = docs.withColumn(the_id, F.col("doc_id").cast("bigint")).withColumn(the_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed(named, gone, [the_id, the_key], "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = keyed(kept, again, [the_id, the_key], "left_semi").dropDuplicates([the_id, the_key])
    return keyed(kept, again, [the_id, the_key], "left_anti").union(once).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none. Repeated rows share their fate."""
    small_batches(spark, 500)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes, one row a document; 0 of null and empty texts. A null
    source is a source, repeated rows are documents."""
    return mix(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The classifier and the hashes have no SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
