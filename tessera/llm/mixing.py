"""Mixing sources to target weights by a low-discrepancy schedule (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table, words

GOLDEN = 0.6180339887498949
_CHUNK = 65536
_CELLS = 1024


def source_targets(sizes: DataFrame, cycle: list[int], share: float, repeats: int) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: columns ``s, source, source_size, target, low, high``.

    Sources weigh ``cycle`` in code point order, null last, repeating. They share ``share`` times all
    words by weight; a target stops at ``repeats`` times its source's size and the excess is shared
    again by weight. Sorted by size over weight, the stopped sources are the leading ones, so one
    running sum finds the level. ``low`` and ``high`` bound the source's part of [0, 1).
    """
    every = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("s", F.row_number().over(by_source) - 1)
    weight = F.element_at(F.array([F.lit(float(w)) for w in cycle]), F.col("s") % len(cycle) + 1)
    t = t.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    t = t.withColumn("rest", F.sum("source_size").over(every) * share - F.sum("cap").over(full) + F.col("cap"))
    t = t.withColumn("weights", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("at", F.row_number().over(full))
    open_ = F.col("cap") * F.col("weights") >= F.col("weight") * F.col("rest")
    t = t.withColumn("cut", F.min(F.when(open_, F.col("at"))).over(every))
    t = t.withColumn("level_rest", F.max(F.when(F.col("at") == F.col("cut"), F.col("rest"))).over(every))
    t = t.withColumn("level_weights", F.max(F.when(F.col("at") == F.col("cut"), F.col("weights"))).over(every))
    stopped = F.col("cut").isNull() | (F.col("at") < F.col("cut"))
    t = t.withColumn(
        "target",
        F.when(stopped, F.col("cap")).otherwise(F.col("weight") * F.col("level_rest") / F.col("level_weights")),
    )
    run = F.sum("target").over(Window.orderBy("s"))
    total = F.sum("target").over(every)
    t = t.withColumn("high", F.when(total > 0, run / total)).withColumn("total", total)
    t = t.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("s")), F.lit(0.0)))
    return t.select("s", "source", "source_size", "target", "low", "high", "total")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """Slots of the mix in order: ``slot, s, rank, block``.

    Slot n is the point frac(n * golden ratio); the source whose part of [0, 1) holds the point gets the
    slot. Points meet the parts through equal cells of [0, 1), an equality join. A source's slots are
    ranked within chunks of slots and offset by the chunks before, so no task ranks a whole source.
    Rank r takes block r modulo the source's number of blocks.
    """
    spark = targets.sparkSession
    total = targets.agg(F.max("total")).first()[0] or 0.0
    slots = spark.range(int(-(-total // block))).select(F.col("id").alias("slot"))
    u = F.col("slot") * GOLDEN
    slots = slots.withColumn("u", u - F.floor(u)).withColumn("cell", F.floor(F.col("u") * _CELLS))
    cells = F.sequence(F.floor(F.col("low") * _CELLS), F.floor(F.col("high") * _CELLS))
    parts = targets.where("low < high").select("s", "source_size", "low", "high", F.explode(cells).alias("cell"))
    got = slots.join(parts, "cell").where("u >= low and u < high")
    got = got.select("slot", "s", F.ceil(F.col("source_size") / block).alias("blocks"))
    got = got.withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    before = Window.partitionBy("s").orderBy("chunk")
    counts = got.groupBy("s", "chunk").count()
    counts = counts.select("s", "chunk", (F.sum("count").over(before) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    got = got.withColumn("inside", inside).join(counts, ["s", "chunk"])
    got = got.withColumn("rank", F.col("before") + F.col("inside"))
    return got.select("slot", "s", "rank", "blocks", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(
    docs: DataFrame,
    cycle: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    repeats: int = 2,
    block: int = 128,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of every document the mix takes: ``doc_id, size, source_size, target, taken``.

    A source's documents stand in an order shuffled by a hash of their id and are cut into blocks of
    ``block`` words; ``schedule`` says how often each block is taken, at most ``repeats`` times. A document
    gets the words of its pieces times the takes of their blocks. Offsets are running sums within hash
    buckets of a source plus the buckets before, so a source with most of the rows is spread. Null and
    blank texts have size 0 and take 0; null ids and repeated rows count like others; a null source is a
    source. ``keep`` names further columns of ``docs`` to return. No documents: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("bigint").alias("size"),
        key.alias("key"),
        F.struct(F.lit(0).alias("_"), *keep).alias("kept"),
    )
    light = scratch.write(sized.drop("kept")) if not keep else scratch.write(sized)
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = scratch.write(source_targets(sizes, list(cycle), share, repeats), 1)
    placed = light.join(targets.select("s", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of")))
    placed = placed.drop("of").withColumn("bucket", F.substring("key", 1, 3))
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("s").orderBy("bucket")) - F.col("sum")
    sums = sums.select("s", "bucket", before.alias("before"))
    inside = F.sum("size").over(
        Window.partitionBy("s", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("size")
    placed = placed.withColumn("inside", inside).join(sums, ["s", "bucket"])
    placed = placed.withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "bucket")
    placed = scratch.write(placed)
    takes = schedule(targets, block).where(F.col("rank") < F.col("blocks") * repeats)
    takes = takes.groupBy("s", "block").agg(F.count("*").alias("takes"))
    end = F.col("start") + F.col("size")
    spans = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = placed.where("size > 0").select("s", "start", "size", F.explode(spans).alias("block"))
    pieces = pieces.join(takes, ["s", "block"]).select(
        "s",
        "start",
        ((F.least(end, (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)) * F.col("takes")).alias("words"),
    )
    taken = pieces.groupBy("s", "start").agg(F.sum("words").alias("taken")).withColumn("full", F.lit(True))
    out = placed.withColumn("full", F.col("size") > 0).join(taken, ["s", "start", "full"], "left")
    out = out.join(targets.select("s", "source_size", "target"), "s")
    more = [F.col(f"kept.{c}").alias(c) for c in keep]
    return out.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), *more
    )


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0') AS key FROM documents),
g AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS s FROM g),
b AS (SELECT *, CASE s % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight, source_size * 2e0 AS cap FROM a),
c AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0 - sum(cap) OVER w + cap AS rest,
             sum(weight) OVER (ORDER BY cap / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
             row_number() OVER w AS pos FROM b WINDOW w AS (ORDER BY cap / weight, s)),
e AS (SELECT *, min(pos) FILTER (WHERE cap * weights >= weight * rest) OVER () AS cut FROM c),
f AS (SELECT *, max(rest) FILTER (WHERE pos = cut) OVER () AS lr, max(weights) FILTER (WHERE pos = cut) OVER () AS lw FROM e),
h AS (SELECT s, source, source_size, CASE WHEN cut IS NULL OR pos < cut THEN cap ELSE weight * lr / lw END AS target FROM f),
i AS (SELECT *, sum(target) OVER (ORDER BY s) / sum(target) OVER () AS high, sum(target) OVER () AS total FROM h),
j AS (SELECT *, coalesce(lag(high) OVER (ORDER BY s), 0e0) AS low FROM i),
n AS (SELECT slot, slot * 0.6180339887498949e0 - floor(slot * 0.6180339887498949e0) AS u
      FROM (SELECT unnest(range(CAST(ceil((SELECT max(total) FROM j) / 128) AS BIGINT))) AS slot)),
m AS (SELECT s, CAST(ceil(source_size / 128e0) AS BIGINT) AS blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS r
      FROM n JOIN j ON u >= low AND u < high),
k AS (SELECT s, r % blocks AS block, count(*) AS takes FROM m WHERE r < 2 * blocks GROUP BY ALL),
p AS (SELECT d.*, j.s, j.source_size, j.target,
             sum(size) OVER (PARTITION BY j.s ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN j ON d.source IS NOT DISTINCT FROM j.source),
q AS (SELECT p.s, p.start, (least(start + size, (block + 1) * 128) - greatest(start, block * 128)) * takes AS words
      FROM p JOIN k ON p.s = k.s AND k.block BETWEEN p.start // 128 AND (p.start + p.size - 1) // 128 WHERE size > 0),
t AS (SELECT s, start, sum(words) AS taken FROM q GROUP BY ALL)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(coalesce(CASE WHEN size > 0 THEN taken END, 0) AS BIGINT) AS taken
FROM p LEFT JOIN t ON p.s = t.s AND p.start = t.start
"""
