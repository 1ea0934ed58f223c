"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_value, small_batches, table

by_value(__name__)

#: A seed ignores the positions with 0. At least one of these hits every stretch of 13 words or more, and every whole item of
#: 8 to 12, of which three quarters agree and whose ends agree, wherever the others are (the tests go through all).
MASKS = ("111011", "11001011", "10100111", "11110001", "10011101", "1010111", "110111")
_WORD = re.compile(r"\w+")
_BLOCK_CHARS = 32_000_000
_HITS = 1_000_000


def tokens_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def longest_overlap(same: np.ndarray, share: float) -> tuple[int, int]:
    """Start and length of the longest stretch whose ends agree, and ``share`` of whose positions do."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0
    height = np.concatenate([[0.0], np.cumsum(same - share)]) + np.arange(len(same) + 1) * 1e-9
    low, high = np.minimum.accumulate(height[at]), height[at + 1]
    first = len(low) - np.searchsorted(low[::-1], high, side="right")  # the first start that is no higher than the end
    length = at - at[first] + 1
    end = int(length.argmax())
    return int(at[first[end]]), int(length[end])


class SeedIndex:
    """Hashes of the benchmark's tokens under every mask, sorted, with the item and position of each."""

    def __init__(self, items: list[tuple], window: int, share: float, shortest: int) -> None:
        self.window, self.share = window, share
        self.numbers: dict[str, int] = {}
        self.ids, self.items = [], []
        keys, owners, places = [], [], []
        random = np.random.default_rng(7)
        self.factors = random.integers(1, 2**63, (len(MASKS), max(map(len, MASKS))), dtype=np.int64).astype(np.uint64) | np.uint64(1)
        for item, text in items:
            words = tokens_of(text)
            if len(words) < shortest:
                continue
            row = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int64)
            for m in range(len(MASKS)):
                hashes, at = self.hashes(row, m)
                keys.append(hashes)
                places.append(at)
                owners.append(np.full(len(at), len(self.ids)))
            self.ids.append(item)
            self.items.append(row)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owners = np.concatenate(owners)[order] if len(keys) else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if len(keys) else np.zeros(0, np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def hashes(self, row: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of mask ``m`` whose chosen tokens are known, and their starts."""
        size = len(row) - len(MASKS[m]) + 1
        if size <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        chosen = [j for j, c in enumerate(MASKS[m]) if c == "1"]
        known = row[chosen[0] : chosen[0] + size] > 0
        for j in chosen[1:]:
            known &= row[j : j + size] > 0
        at = np.flatnonzero(known)
        total = np.full(len(at), m, np.uint64)
        for j in chosen:
            total += row[at + j].astype(np.uint64) * self.factors[m, j]
        total ^= total >> np.uint64(29)
        return total * np.uint64(0x9E3779B97F4A7C15), at

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """Text number, item number, first token, length and agreeing tokens of the longest overlap of each pair
        of a text and an item that reaches the window."""
        if not len(self.keys):
            return
        gap = max(map(len, MASKS))
        get, rows, starts, at = self.numbers.get, [], [], 0
        for t in texts:
            row = np.array([get(w, 0) for w in tokens_of(t)] + [0] * gap, np.int64)
            starts.append(at)
            at += len(row)
            rows.append(row)
        if not rows:
            return
        row, starts = np.concatenate(rows), np.array(starts)
        found = []
        for m in range(len(MASKS)):
            hashes, places = self.hashes(row, m)
            likely = self.maybe[(hashes >> np.uint64(44)).astype(np.int64)]
            hashes, places = hashes[likely], places[likely]
            lo, hi = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
            n = hi - lo
            ends = np.cumsum(n)
            # words that repeat in a text and an item hit at every pair of places: a bounded number of hits at a time
            cuts = [*np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, _HITS)).tolist(), len(n)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                some = n[a:b]
                hit = np.repeat(lo[a:b] - (np.cumsum(some) - some), some) + np.arange(some.sum())
                place = np.repeat(places[a:b], some)
                text = np.searchsorted(starts, place, "right") - 1
                found.append(np.unique(np.stack([text, self.owners[hit], place - self.places[hit]], axis=1), axis=0))
        best: dict[tuple[int, int], tuple] = {}
        for k, i, d in np.unique(np.concatenate(found), axis=0).tolist() if found else ():
            item = self.items[i]
            lo = max(starts[k] - d, 0)
            hi = min(starts[k] + len(rows[k]) - gap - d, len(item))
            same = row[d + lo : d + hi] == item[lo:hi]
            start, length = longest_overlap(same, self.share)
            if length >= min(self.window, len(item)):
                got = (length, int(same[start : start + length].sum()), int(d + lo + start - starts[k]))
                best[k, i] = max(best.get((k, i), got), got)
        for (k, i), (length, agree, start) in best.items():
            yield k, i, start, length, agree


def seed_indexes(benchmark: DataFrame, window: int, share: float, shortest: int, id_col: str = "item_id", text_col: str = "text"):
    """Indexes of the benchmark in blocks of a bounded size: all the texts of one are on the driver at once."""
    items = benchmark.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    blocks = -(-total // _BLOCK_CHARS) or 1
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        yield SeedIndex(sorted((tuple(r) for r in part.collect()), key=str), window, share, shortest)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    share: float = 0.75,
    shortest: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, doc_start, length, agreeing``: the documents that hold a benchmark item's words.

    Words are runs of word characters in lower case. A document and an item are paired if they agree under a
    mask somewhere, and on that alignment a stretch of ``window`` words (or the whole item, if shorter)
    agrees in ``share`` of its positions, so substituted words don't hide a passage. Items of fewer than
    ``shortest`` words can't be told from chance and are passed over. One row a document row and item, with
    the longest stretch. Null and empty texts match nothing; null ids and repeated rows are reported like
    others; texts of any length count whole; other columns are ignored; an empty table on either side gives no
    rows. The benchmark is read in blocks of a fixed size, and every block meets all documents.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType
    arrow_type = to_arrow_type(item_type)
    fields = [StructField("doc_id", docs.schema[id_col].dataType), StructField("item_id", item_type)]
    schema = StructType([*fields, *[StructField(c, LongType()) for c in ("doc_start", "length", "agreeing")]])
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in seed_indexes(benchmark, window, share, shortest):
        sent = spark.sparkContext.broadcast(index.__dict__)

        def run(batches, sent=sent):
            index = SeedIndex.__new__(SeedIndex)
            index.__dict__ = sent.value
            for b in batches:
                got = list(index.find(b["text"].to_pylist()))
                if got:
                    text, item, *rest = zip(*got, strict=True)
                    ids = pa.array([index.ids[i] for i in item], arrow_type)
                    yield pa.RecordBatch.from_arrays(
                        [b["doc_id"].take(pa.array(text)), ids, *[pa.array(x, pa.int64()) for x in rest]],
                        names=["doc_id", "item_id", "doc_start", "length", "agreeing"],
                    )

        found = picked.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.75, shortest: int = 8, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``overlaps`` doesn't report; null and empty texts stay."""
    for index in seed_indexes(benchmark, window, share, shortest):
        sent = docs.sparkSession.sparkContext.broadcast(index.__dict__)

        def run(batches, sent=sent):
            index = SeedIndex.__new__(SeedIndex)
            index.__dict__ = sent.value
            for b in batches:
                bad = {k for k, *_ in index.find(b[text_col].to_pylist())}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    small_batches(spark, 500)
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
