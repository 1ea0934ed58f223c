"""Document fingerprints by a homomorphic multiset hash (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, let, table, words

#: Lanes of the hash of a whole paragraph.
WIDE = 8
#: Lanes of the paragraph's word pairs; two to a sum.
NARROW = 64
_BITS = 32
_LOWEST = -(2**63)


def fingerprint_sums(texts: DataFrame) -> DataFrame:
    """``key, wide, narrow`` for ``texts(key, text)``: sums over the paragraphs of each key.

    A text is the multiset of its paragraphs, the parts between \\n. Each has a vector: WIDE numbers below
    2 ** 32 hashed from all of it, and NARROW small ones, to which each of its word pairs adds
    1 or -1 at a place chosen by hash. The fingerprint is the sum of the vectors modulo 2 ** 32, more than any
    text has word pairs. So order doesn't matter, and a paragraph is inserted or deleted by adding or taking away
    its own vector (``combine``).
    """
    rows = texts.select("key", F.explode(F.split("text", "\n")).alias("p")).select("key", "p", words(F.col("p")).alias("w"))
    # row -1 is the paragraph, the others are its word pairs; an outer explode, as the other would filter on the words first
    at = F.sequence(F.lit(-1), F.greatest(F.size("w") - 2, F.lit(0)))
    rows = rows.select("key", "p", "w", F.explode_outer(at).alias("i"))
    own = F.col("i") < 0
    pair = F.xxhash64(F.get("w", F.col("i")), F.get("w", F.col("i") + 1))
    rows = rows.select("key", own.alias("own"), F.when(own, F.xxhash64("p")).otherwise(pair).alias("h"))
    slot = F.pmod("h", F.lit(NARROW))
    sign = F.when(F.col("h") < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    step = F.when(slot % 2 == 0, sign).otherwise(sign * 2**_BITS)
    place = F.when(F.col("own"), F.lit(-1)).otherwise(F.floor(slot / 2)).cast("int")
    rows = rows.select("key", "own", "h", step.alias("step"), place.alias("place"))
    wide = [F.sum(F.when(F.col("own"), F.pmod(F.xxhash64("h", F.lit(i)), F.lit(2**_BITS))).otherwise(0)) for i in range(WIDE)]
    packed = [F.sum(F.when(F.col("place") == i, F.col("step")).otherwise(0)) for i in range(NARROW // 2)]
    sums = rows.groupBy("key").agg(*[x.alias(f"w{i}") for i, x in enumerate(wide)], *[x.alias(f"s{i}") for i, x in enumerate(packed)])
    low = lambda i: F.pmod(F.col(f"s{i}") + 2 ** (_BITS - 1), F.lit(2**_BITS)) - 2 ** (_BITS - 1)
    high = lambda i: F.expr(f"(s{i} - (pmod(s{i} + {2 ** (_BITS - 1)}L, {2**_BITS}L) - {2 ** (_BITS - 1)}L)) div {2**_BITS}L")
    lanes = [F.pmod(lane(i), F.lit(2**_BITS)) for i in range(NARROW // 2) for lane in (low, high)]
    return sums.select("key", F.array(*[F.pmod(f"w{i}", F.lit(2**_BITS)) for i in range(WIDE)]).alias("wide"), F.array(*lanes).alias("narrow"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of two fingerprints added (a text with more paragraphs) or subtracted (with fewer)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y * sign, F.lit(2**_BITS)))


def as_text(wide: Column, narrow: Column) -> Column:
    part = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), _BITS // 4, "0")), "")
    return F.concat(part(wide), part(narrow))


def likeness(wide_a: Column, narrow_a: Column, wide_b: Column, narrow_b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the signed lanes of word pairs, at least 0 and below 1."""
    half = 2 ** (_BITS - 1)
    signed = lambda v: F.transform(v, lambda x: F.when(x >= half, x - 2**_BITS).otherwise(x).cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def cosine(v: Column) -> Column:
        size = F.sqrt(dot(v["a"], v["a"])) * F.sqrt(dot(v["b"], v["b"]))
        return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1 - 1e-9), dot(v["a"], v["b"]) / size))).otherwise(0.0)

    same = (wide_a == wide_b) & (narrow_a == narrow_b)
    return F.when(same, F.lit(1.0)).otherwise(let(F.struct(signed(narrow_a).alias("a"), signed(narrow_b).alias("b")), cosine))


def with_next(docs: DataFrame, rows: int = 5000) -> DataFrame:
    """``docs(doc_id, text)`` with ``next``, the following row's text by ascending id, and row numbers ``key, next_key``.

    Null ids come first; rows with one id go by a hash of their text. Rows are dealt into ranges between the keys of
    one row in ``rows``, picked by hash, so no task sorts everything; the driver holds 16 bytes a range. A range's
    first row also goes to the range before it, the very first one to the last.
    """
    raw = lambda c: F.unhex(F.lpad(F.hex(c.bitwiseXOR(F.lit(_LOWEST))), 16, "0"))  # noqa: E731  bytes in the order of numbers
    known = F.when(F.col("doc_id").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    by = F.concat(known, raw(F.coalesce("doc_id", F.lit(0))), raw(F.xxhash64("text")))
    named = docs.withColumn("by", by)
    cuts = sorted(bytes(r[0]) for r in named.where(F.pmod(F.xxhash64("by"), F.lit(rows)) == 0).select("by").distinct().collect())
    lowest = named.agg(F.min("by")).first()[0]
    bounds, size = F.lit(b"".join(cuts)), 17
    cut = lambda k: F.substring(bounds, (k * size + 1).cast("int"), F.lit(size))
    half = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def look(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        after = (s["lo"] < s["hi"]) & (cut(mid) <= F.col("by"))
        return F.struct(
            F.when(after, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(after | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    part = F.aggregate(steps, half, look, lambda s: s["lo"])
    dealt = named.withColumn("part", part)
    very_first = F.col("by") == F.lit(None if lowest is None else bytes(lowest))
    lead = very_first | (F.col("part") > 0) & (F.col("by") == cut(F.col("part") - 1))
    back = F.when(very_first, F.lit(len(cuts))).otherwise(F.col("part") - 1)
    places = F.array(F.struct("part", F.lit(False).alias("tail")), F.when(lead, F.struct(back.alias("part"), F.lit(True).alias("tail"))))
    spread = dealt.select("doc_id", "text", "by", F.col("part").alias("home"), F.explode(places).alias("x")).where("x is not null")
    w = Window.partitionBy("part").orderBy("tail", "by")
    spread = spread.select("doc_id", "text", "by", "home", "x.*").withColumn("at", F.row_number().over(w))
    after = F.lead(F.struct("text", "home", "tail")).over(w).alias("after")
    spread = spread.select("doc_id", "text", "part", "at", "tail", after).where(~F.col("tail"))
    number = lambda p, at: F.shiftleft(p.cast("bigint"), 32) + at
    key, own = number(F.col("part"), F.col("at")), F.col("after.home")
    next_key = F.when(F.col("after.tail"), number(own, F.lit(1))).otherwise(key + 1)
    return spread.select(key.alias("key"), next_key.alias("next_key"), "doc_id", "text", F.col("after.text").alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness, one row per row of ``docs``.

    Null texts count as empty; texts of any length count whole. The edited text has its last quarter of code points
    replaced by the first as many (or all) of the next text. See ``with_next`` for the order (null and repeated ids,
    repeated rows) and ``fingerprint_sums`` for the hash. Texts that are equal, or equal but for the order of their
    paragraphs, have equal fingerprints. Other columns are ignored; no documents give no rows, and a single one is its own next.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))
    rows = scratch.write(with_next(base).select("key", "next_key", "doc_id", "text", edited.alias("edited")))
    about = rows.select("key", "next_key", "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    twice = F.array(F.struct((F.col("key") * 2).alias("key"), F.col("text")), F.struct((F.col("key") * 2 + 1).alias("key"), F.col("edited").alias("text")))
    sums = scratch.write(fingerprint_sums(rows.select(F.explode(twice).alias("x")).select("x.key", "x.text")))
    about = scratch.write(about)
    scratch.drop(rows)
    of = lambda odd, mark, key: sums.where(F.col("key") % 2 == odd).select(
        F.floor(F.col("key") / 2).alias(key), F.col("wide").alias(f"wide{mark}"), F.col("narrow").alias(f"narrow{mark}")
    )
    out = about.join(of(0, "", "key"), "key").join(of(1, "_e", "key"), "key").join(of(0, "_n", "next_key"), "next_key")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("wide"), F.col("narrow")).alias("fingerprint"),
        as_text(F.col("wide_e"), F.col("narrow_e")).alias("edited_fingerprint"),
        likeness(F.col("wide"), F.col("narrow"), F.col("wide_e"), F.col("narrow_e")).alias("near_edited"),
        likeness(F.col("wide"), F.col("narrow"), F.col("wide_n"), F.col("narrow_n")).alias("near_next"),
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
