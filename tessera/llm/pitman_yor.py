"""Language-model scores by a hierarchical Pitman-Yor model.

Words are dishes. The context of a token is the word before it, hashed to one of a number of restaurants that
grows with the text (``context_bits``). A restaurant sends its tables as customers to its parent, which all words
with the same last letter share, and this to the root, whose base is uniform over the training words and one
unknown word.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from functools import reduce
from itertools import count
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, by_value, id_remainder, small_batches, table

by_value(__name__)

#: Parents: the low bits of the last byte of the word before.
PARENTS = 32
END = b""
STRENGTH = 1.0
#: Customers whose dishes are seated at once; a dish of more is a group of its own.
GROUP = 1 << 22
#: So few dishes are seated one at a time.
FEW_DISHES = 24
#: Bytes of text to a bucket of words.
BUCKET_BYTES = 8 << 20
#: Parts of the buckets, and of the batches, that are dealt out one after the other, as a shuffle is as large as what it deals.
_PARTS = 8
_PLANES = "planes"
_SCHEMA = "kind int, batch bigint, bucket int, body binary"
_ARROW = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])


def _planes(x):
    """Arrays of numbers as all their first bytes, then all second bytes and so on, which compress better."""
    if isinstance(x, np.ndarray) and x.dtype.itemsize > 1:
        return _PLANES, x.dtype.str, np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    if isinstance(x, dict):
        return {k: _planes(v) for k, v in x.items()}
    return type(x)(map(_planes, x)) if type(x) in (tuple, list) else x


def _whole(x):
    """What ``_planes`` was given."""
    if isinstance(x, dict):
        return {k: _whole(v) for k, v in x.items()}
    if type(x) is tuple and len(x) == 3 and type(x[0]) is str and x[0] == _PLANES:
        return np.ascontiguousarray(x[2].T).reshape(-1).view(x[1])
    return type(x)(map(_whole, x)) if type(x) in (tuple, list) and not (x and type(x[0]) in (int, bool, type(None))) else x


def _pack(body) -> bytes:
    data = pickle.dumps(_planes(body), protocol=5)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: bytes):
    return _whole(pickle.loads(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd")))


def _small(a: np.ndarray) -> np.ndarray:
    """Numbers that fit in 32 bits take no more while they are sent."""
    return a.astype(np.int32) if a.dtype == np.int64 and len(a) and a.max() < 2**31 and a.min() >= -(2**31) else a


def _rows(rows: list[tuple]):
    for kind, batch, bucket, body in rows:
        data = [[kind], [batch], [bucket], [_pack(body)]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, _ARROW.types, strict=True)], schema=_ARROW)


class _Batch:
    """Documents of one task, up to a size: tokens by number, counts by word and context."""

    def __init__(self, bits: int) -> None:
        self.bits, self.numbers = bits, defaultdict(count().__next__)
        self.ids, self.train, self.lengths, self.tokens, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, train: bool, text: bytes) -> None:
        found = [*text.lower().split(), END]
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, found), np.int32, len(found)))
        self.ids.append(doc_id)
        self.train.append(train)
        self.lengths.append(len(self.tokens[-1]))
        self.size += len(text)

    def rows(self, batch: int, buckets: int):
        """A row with the documents, and a row for each bucket of words with their counts by context."""
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.numbers], np.uint64)
        parents = np.array([w[-1] % PARENTS if w else 0 for w in self.numbers], np.int64)
        inner = self.bits - PARENTS.bit_length() + 1
        own = parents << inner | (hashes & np.uint64((1 << inner) - 1)).astype(np.int64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes = hashes[order]
        tokens, lengths = np.concatenate(self.tokens), np.array(self.lengths)
        context = np.empty(len(tokens), np.int64)
        context[1:] = own[tokens[:-1]]
        context[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = 0
        pairs, at = np.unique(rank[tokens] << self.bits | context, return_inverse=True)
        train = np.repeat(np.array(self.train), lengths)
        counts = np.bincount(at[train], minlength=len(pairs))
        word, context = pairs >> self.bits, (pairs & (1 << self.bits) - 1).astype(np.uint32)
        new = np.append(True, word[1:] != word[:-1])
        docs = (self.ids, self.train, lengths.astype(np.int32), at.astype(np.int32), np.packbits(new), len(pairs))
        yield 0, batch, -1, docs
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        cuts = np.searchsorted(word, edges)
        for b in np.flatnonzero(np.diff(edges)):
            lo, hi = cuts[b], cuts[b + 1]
            per_word = np.bincount(word[lo:hi] - edges[b], minlength=edges[b + 1] - edges[b])
            yield 1, batch, int(b), (hashes[edges[b] : edges[b + 1]], per_word.astype(np.uint32), context[lo:hi], counts[lo:hi].astype(np.uint32))


def _merge(parts: list[tuple], bits: int) -> tuple:
    """Words, and the word, context and positive count of each pair, of several such parts; sorted."""
    words = np.unique(np.concatenate([p[0] for p in parts]))
    keys = np.concatenate([np.repeat(np.searchsorted(words, p[0]), p[1]) << bits | p[2] for p in parts])
    keys, at = np.unique(keys, return_inverse=True)
    counts = np.bincount(at, np.concatenate([p[3] for p in parts]), len(keys)).astype(np.int64)
    return words, keys >> bits, keys & (1 << bits) - 1, counts


class Tables:
    """Tables of many dishes: the customers ``n`` of each dish, and the sizes of the tables of those with two or more,
    ``size``, in the order of their dishes, ``dish``. A dish with one customer has one table."""

    def __init__(self, n: np.ndarray) -> None:
        self.n = n.astype(np.int64)
        self.dish = np.flatnonzero(n > 1)
        self.size = self.n[self.dish].copy()

    def count(self) -> np.ndarray:
        t = np.bincount(self.dish, minlength=len(self.n))
        return np.where(t > 0, t, np.minimum(self.n, 1))

    def remove(self, who: np.ndarray, random) -> None:
        """One customer of each of the dishes ``who``, which have two or more, leaves; each is as likely."""
        ends = np.cumsum(self.size)
        before = ends[np.searchsorted(self.dish, who)] - self.size[np.searchsorted(self.dish, who)]
        at = np.searchsorted(ends, before + random.integers(0, self.n[who]), side="right")
        self.size[at] -= 1
        self.n[who] -= 1
        keep = self.size > 0
        self.dish, self.size = self.dish[keep], self.size[keep]

    def add(self, who: np.ndarray, discount: float, fresh: np.ndarray, random) -> None:
        """A customer of each dish ``who`` comes: to a table of s with weight s - discount, to a new one with ``fresh`` (for each
        dish, ``fresh(tables)`` of its own)."""
        lone = who[self.n[who] == 1]
        if len(lone):
            self._insert(lone[~np.isin(lone, self.dish)])
        first, past = np.searchsorted(self.dish, who), np.searchsorted(self.dish, who, side="right")
        own = past - first
        old = self.n[who] - discount * own
        new = random.random(len(who)) * (old + fresh(own)) >= old
        ends = np.cumsum(self.size - discount)
        stay = ~new
        start = ends[first[stay]] - (self.size[first[stay]] - discount)
        at = np.searchsorted(ends, start + random.random(int(stay.sum())) * old[stay], side="right")
        np.add.at(self.size, np.clip(at, first[stay], past[stay] - 1), 1)
        self._insert(who[new])
        self.n[who] += 1

    def _insert(self, who: np.ndarray) -> None:
        if not len(who):
            return
        at = np.searchsorted(self.dish, who, side="right")
        self.dish, self.size = np.insert(self.dish, at, who), np.insert(self.size, at, 1)

    def take(self, who: np.ndarray) -> Tables:
        """The dishes ``who``, ascending, on their own, numbered from 0; ``put`` brings them back."""
        mine = np.zeros(len(self.n), bool)
        mine[who] = True
        mine = mine[self.dish]
        part = Tables.__new__(Tables)
        part.n, part.dish, part.size = self.n[who], np.searchsorted(who, self.dish[mine]), self.size[mine]
        self.dish, self.size = self.dish[~mine], self.size[~mine]
        return part

    def put(self, who: np.ndarray, part: Tables) -> None:
        dish, size = np.concatenate([self.dish, who[part.dish]]), np.concatenate([self.size, part.size])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], size[order]
        self.n[who] = part.n

    def tidy(self) -> None:
        """Dishes that are left with one customer need no list."""
        keep = self.n[self.dish] > 1
        self.dish, self.size = self.dish[keep], self.size[keep]


class Seating:
    """All seats of one bucket's words: tables by context and word, by parent and word, and by word."""

    def __init__(self, words, word, context, count, bits: int) -> None:
        self._index(words, word, context, bits)
        self.pairs = Tables(count)
        self.mid = Tables(np.bincount(self.group, minlength=len(self.groups)))
        self.top = Tables(np.bincount(self.groups // PARENTS, minlength=len(words)))
        self.samples: list[tuple] = []

    def _index(self, words, word, context, bits: int) -> None:
        """Numbers of the pairs, which are in the order of words and contexts, and of their parents' pairs."""
        self.words, self.word, self.context, self.bits = words, word, context, bits
        self.inner = bits - PARENTS.bit_length() + 1
        keys = word * PARENTS + (context >> self.inner)
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        self.groups, self.group = keys[new], np.cumsum(new) - 1

    def state(self, seats: bool = True) -> dict:
        """What the rest follows from, as arrays: workers that don't have the library can't name its classes. Without ``seats``
        only what ``answer`` needs."""
        per_word = np.bincount(self.word, minlength=len(self.words))
        body = {"words": self.words, "per_word": _small(per_word), "context": _small(self.context), "n": _small(self.pairs.n)}
        if seats:
            for name in ("pairs", "mid", "top"):
                tables = getattr(self, name)
                body[name] = _small(np.bincount(tables.dish, minlength=len(tables.n))[tables.n > 1]), _small(tables.size)
        return body | {"samples": self.samples, "bits": self.bits}

    @classmethod
    def of(cls, state: dict) -> Seating:
        s = cls.__new__(cls)
        wide = {k: state[k].astype(np.int64) for k in ("per_word", "context", "n")}
        s._index(state["words"], np.repeat(np.arange(len(state["words"])), wide["per_word"]), wide["context"], state["bits"])
        n, s.samples = wide["n"], state["samples"]
        s.pairs = Tables(n)
        if "pairs" in state:
            for name, below in (("pairs", None), ("mid", s.group), ("top", s.groups // PARENTS)):
                tables = Tables(n if below is None else np.bincount(below, count, int(below[-1]) + 1 if len(below) else 0))
                times, size = state[name]
                tables.dish, tables.size = np.repeat(tables.dish, times), size.astype(np.int64)
                count = tables.count()
                setattr(s, name, tables)
        return s

    def totals(self) -> np.ndarray:
        """Customers and tables by context, by parent and of the root, and distinct words."""
        e, k = 1 << self.bits, PARENTS
        sums = [np.bincount(self.context, self.pairs.n, e), np.bincount(self.context, self.pairs.count(), e)]
        sums += [np.bincount(self.groups % k, x, k) for x in (self.mid.n, self.mid.count())]
        return np.concatenate([*sums, [self.top.n.sum(), self.top.count().sum(), len(self.words)]])


class Totals:
    def __init__(self, sums: np.ndarray, bits: int) -> None:
        e, k = 1 << bits, PARENTS
        kind = np.int32 if sums.max(initial=0) < 2**31 else np.int64
        self.c2, self.t2 = sums[:e].astype(kind), sums[e : 2 * e].astype(kind)
        self.c1, self.t1 = sums[2 * e : 2 * e + k], sums[2 * e + k : 2 * (e + k)]
        self.c0, self.t0, self.distinct = sums[2 * (e + k) : 2 * (e + k) + 3]


def _predict(n, t, total_n, total_t, discount, parent):
    return (n - discount * t + (STRENGTH + discount * total_t) * parent) / (STRENGTH + total_n)


def _levels(s: Seating, t: Totals, d: tuple, n2, t2, n1, t1, n0, t0):
    """Predictive probabilities of the bucket's words at the root, of its groups, and of its pairs."""
    p0 = _predict(n0, t0, t.c0, t.t0, d[0], 1 / (t.distinct + 1))
    of = s.groups % PARENTS
    p1 = _predict(n1, t1, t.c1[of], t.t1[of], d[1], p0[s.groups // PARENTS])
    p2 = _predict(n2, t2, t.c2[s.context], t.t2[s.context], d[2], p1[s.group])
    return p0, p1, p2


def _settle(tables: Tables, wanted: np.ndarray, weight, discount: float, random) -> None:
    """Customers leave and come until each dish has ``wanted``, as the tables below it went and came.

    Few dishes lack many customers: these go on by themselves, so that a step costs no more than they have tables.
    """
    while len(who := np.flatnonzero(tables.n != wanted)):
        if 4 * len(who) < len(wanted):
            part = tables.take(who)
            _settle(part, wanted[who], lambda some, own, who=who: weight(who[some], own), discount, random)
            tables.put(who, part)
            break
        if len(less := who[tables.n[who] > wanted[who]]):
            tables.remove(less, random)
        if len(more := who[tables.n[who] < wanted[who]]):
            tables.add(more, discount, lambda own, more=more: weight(more, own), random)
    tables.tidy()


def _resit(tables: Tables, weight, discount: float, moves: int | None, random) -> None:
    """Gibbs steps: the customers of each dish (or ``moves`` of them) leave in random order, one by one, and take a seat given
    all others.

    Step j moves one customer of every dish that has so many; the last few dishes, of most customers, go on one at a time.
    A customer who stays at the old tables sits down with another at random, who lets him by (s - discount) / s at a
    table of s, so a step costs the same whatever the number of tables. Dishes are taken in groups of ``GROUP`` customers.
    Where one of two customers leaves, the other is alone at a table, however they sat: the last step alone tells how they sit.
    """
    two = np.flatnonzero(tables.n == 2)
    w = weight(two, np.ones(len(two)))
    apart = (random.random(len(two)) * (1 - discount + w) < w).astype(np.int64)
    who = np.flatnonzero(tables.n > 2)
    who = who[np.argsort(-tables.n[who], kind="stable")]
    dishes, sizes = [np.repeat(two, 1 + apart)], [np.repeat(2 - apart, 1 + apart)]
    group = np.cumsum(tables.n[who]) // GROUP
    for some in np.split(who, np.flatnonzero(np.diff(group)) + 1):
        dish, size = _resit_some(tables, some, weight, discount, moves, random)
        dishes.append(dish)
        sizes.append(size)
    dish = np.concatenate(dishes)
    order = np.argsort(dish, kind="stable")
    tables.dish, tables.size = dish[order], np.concatenate(sizes)[order]


def _resit_some(tables: Tables, who: np.ndarray, weight, discount: float, moves: int | None, random) -> tuple[np.ndarray, np.ndarray]:
    """The tables, by dish, of the dishes ``who`` after ``_resit``; these are in the order of falling customers."""
    n = tables.n[who]
    last = n if moves is None else np.minimum(n, moves)
    first = np.searchsorted(tables.dish, who)
    t = np.searchsorted(tables.dish, who, side="right") - first
    ends = np.cumsum(t)
    old = tables.size[np.repeat(first - ends + t, t) + np.arange(t.sum())]
    start = np.cumsum(n) - n
    # the table of each customer; a table that customer c opens has the number old tables + c
    seat, size = np.repeat(np.arange(len(old), dtype=np.int32), old), np.concatenate([old, np.zeros(n.sum(), np.int64)]).astype(np.int32)
    table_of = np.concatenate([np.repeat(who, t), np.repeat(who, n)])
    plain = weight(who, np.zeros(len(who)))
    by_table = weight(who, np.ones(len(who))) - plain  # the weight of a new table grows evenly
    others = n - 1.0
    left_at = [*(len(last) - np.cumsum(np.bincount(last))).tolist(), 0]  # dishes with a step j
    j = 0
    while (m := left_at[j]) > FEW_DISHES:
        c, own, many, tm = start[:m] + j, others[:m], n[:m], t[:m]
        u = random.random((3, m))
        leaver = c + (u[0] * (many - j)).astype(np.int64)
        k = seat[leaver]
        seat[leaver] = seat[c]
        left = size[k] - 1
        size[k] = left
        tm -= left == 0
        w = plain[:m] + by_table[:m] * tm
        new = u[1] * (own - discount * tm + w) < w
        drawn = u[2] * own
        host = drawn.astype(np.int64)
        drawn -= host  # as good as another number
        host += host >= j
        k = seat[start[:m] + host]
        x = size[k]
        again = np.flatnonzero(~new & (drawn * x >= x - discount))
        while len(again):
            v = random.random((2, len(again)))
            host = (v[0] * own[again]).astype(np.int64)
            host += host >= j
            k[again] = seat[start[again] + host]
            x = size[k[again]]
            again = again[v[1] * x >= x - discount]
        k[new] = len(old) + c[new]
        size[k] += 1
        seat[c] = k
        tm += new
        j += 1
    seats, sized, draw = seat.data, size.data, Random(int(random.integers(1 << 62))).random
    for i in range(m):
        _resit_one(seats, sized, int(start[i]), int(n[i]), j, int(last[i]), int(t[i]), len(old), float(plain[i]), float(by_table[i]), discount, draw)
    alive = np.flatnonzero(size)
    return table_of[alive], size[alive].astype(np.int64)


def _resit_one(seat, size, start: int, n: int, j: int, last: int, t: int, old: int, plain: float, by_table: float, discount: float, draw) -> None:
    """The steps of ``_resit_some`` for a single dish from its customer ``j`` on."""
    others = n - 1
    for at in range(j, last):
        c = start + at
        leaver = c + int(draw() * (n - at))
        k = seat[leaver]
        seat[leaver] = seat[c]
        size[k] = left = size[k] - 1
        if not left:
            t -= 1
        w = plain + by_table * t
        if draw() * (others - discount * t + w) < w:
            k, x = old + c, 0
            t += 1
        else:
            while True:
                host = int(draw() * others)
                k = seat[start + host + (host >= at)]
                x = size[k]
                if draw() * x < x - discount:
                    break
        size[k] = x + 1
        seat[c] = k


def sweep(s: Seating, t: Totals, d: tuple, random) -> None:
    """Gibbs steps over the bucket, one for every customer: contexts first, then their parents, whose customers are the tables
    below.

    Tables of other dishes are those of the sums ``t`` after the last sweep; a dish's own are up to date.
    """
    b2, b1, b0 = s.pairs.count(), s.mid.count(), s.top.count()
    p0, p1, _ = _levels(s, t, d, s.pairs.n, b2, s.mid.n, b1, s.top.n, b0)
    of = s.groups % PARENTS
    weigh = lambda others, discount, parent: lambda who, own: (STRENGTH + discount * (others[who] + own)) * parent[who]
    _resit(s.pairs, weigh(t.t2[s.context] - b2, d[2], p1[s.group]), d[2], None, random)
    middle = weigh(t.t1[of] - b1, d[1], p0[s.groups // PARENTS])
    _settle(s.mid, np.bincount(s.group, s.pairs.count(), len(s.groups)).astype(np.int64), middle, d[1], random)
    _resit(s.mid, middle, d[1], None, random)
    top = weigh(t.t0 - b0, d[0], np.full(len(s.words), 1 / (t.distinct + 1)))
    _settle(s.top, np.bincount(s.groups // PARENTS, s.mid.count(), len(s.words)).astype(np.int64), top, d[0], random)
    _resit(s.top, top, d[0], None, random)


def _sample(s: Seating) -> tuple:
    """What a prediction needs of the seats: tables by context, and customers and tables above."""
    return tuple(x.astype(np.int32) for x in (s.pairs.count(), s.mid.n, s.mid.count(), s.top.n, s.top.count()))


def prepare(s: Seating, samples: list[Totals], d: tuple) -> tuple:
    """What all requests to a bucket share: training counts of the words, keys of the pairs, and for each sample the probabilities of
    unseen words, and of the words, groups and pairs."""
    count = np.bincount(s.word, s.pairs.n, max(len(s.words), 1)).astype(np.int64)
    levels = []
    for (t2, n1, t1, n0, t0), t in zip(s.samples, samples, strict=True):
        p0, p1, p2 = _levels(s, t, d, s.pairs.n, t2, n1, t1, n0, t0)
        levels.append((np.append(p0, _predict(0, 0, t.c0, t.t0, d[0], 1 / (t.distinct + 1))), p1, p2))
    return count, s.word << s.bits | s.context, levels


def answer(s: Seating, samples: list[Totals], d: tuple, request: tuple, ready: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the averaged predictive probability of each requested pair, and each word's training count; ``ready`` is what
    ``prepare`` gives."""
    counts, keys, levels = ready or prepare(s, samples, d)
    words, per_word, context, _ = request
    context = context.astype(np.int64)
    own = np.searchsorted(s.words, words)
    found = own < len(s.words)
    found[found] = s.words[own[found]] == words[found]
    own[~found] = 0
    count = np.where(found, counts[own], 0)
    own[~found] = len(s.words)  # the unseen word
    word = np.repeat(own, per_word)

    def find(keys, wanted):
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        there = np.flatnonzero(keys[at] == wanted) if len(keys) else at[:0]
        return there, at[there]

    of = context >> s.inner
    in_pair, pair = find(keys, word << s.bits | context)
    rest = np.ones(len(word), bool)
    rest[in_pair] = False
    rest = np.flatnonzero(rest)  # of these the levels above tell
    word, context, of = word[rest], context[rest], of[rest]
    in_group, group = find(s.groups, word * PARENTS + of)
    total = np.zeros(len(rest) + len(pair))
    for (p0, p1, p2), t in zip(levels, samples, strict=True):
        p = _predict(0, 0, t.c1[of], t.t1[of], d[1], p0[word])
        p[in_group] = p1[group]
        total[rest] += _predict(0, 0, t.c2[context], t.t2[context], d[2], p)
        total[in_pair] += p2[pair]
    return np.log10(total / len(samples)), count


def _stream(batches):
    """Rows of Arrow batches, one at a time: kind, batch, bucket, body."""
    for b in batches:
        for kind, batch, bucket, body in zip(b["kind"], b["batch"], b["bucket"], b["body"], strict=True):
            yield kind.as_py(), batch.as_py(), bucket.as_py(), _unpack(body.as_buffer().to_pybytes())


def context_bits(size: int) -> int:
    """Restaurants for ``size`` bytes of text, as a power of two: one a kilobyte, 1024 at least and 4 million at most, so
    that the sums by restaurant, which every task reads, stay below 100 MB."""
    return min(max((size >> 10).bit_length(), 10), 22)


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones else 0.5


def score_texts(
    docs: DataFrame,
    train: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    burn_in: int = 3,
    samples: int = 3,
    batch_bytes: int = 12 << 20,
    seed: int = 0,
) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    ``train`` is a boolean SQL expression over the columns of ``docs``; null counts as false. Texts are
    lower-cased in A-Z; tokens are the runs of other than white space and one end. A null text is empty: one
    token. Null ids and repeated rows are scored like others; other columns are ignored.

    1. Each task numbers the words of up to ``batch_bytes`` of text and sends, for each bucket of word
       hashes, its words' counts by context. A longer text is a batch of its own. 2. A bucket merges them
       as they stream in. 3. Gibbs sweeps seat the customers bucket by bucket; between sweeps only the sums by
       restaurant (``context_bits``) come together. 4. Each bucket answers the batches with averaged
       predictive probabilities, and the batches sum them by text. A bucket holds the words of about 8 MB of text, so their
       number follows the input; everything is read from tables in the shared folder, so lost executors only repeat tasks. Buckets and
    batches are dealt out in ``_PARTS`` parts, and what was read for the last time is removed.

    A seat is drawn given the same dish's other seats as they are, and given other dishes' as they were after the last
    sweep, which is what lets buckets work side by side. No documents: no rows; no training text: the base alone.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.expr(train).cast("boolean"), F.lit(False)).alias("train"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = base.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    buckets, bits = max(size // BUCKET_BYTES, 16), context_bits(size)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, -(-buckets // _PARTS))

    def read(batches):
        from pyspark import TaskContext

        part, k, batch = TaskContext.get().partitionId(), 0, _Batch(bits)
        for b in batches:
            for doc_id, is_train, text in zip(b["doc_id"], b["train"], b["text"], strict=True):
                raw = text.as_buffer().to_pybytes()
                if batch.ids and batch.size + len(raw) > batch_bytes:
                    yield from _rows_of(batch, part << 32 | k)
                    k, batch = k + 1, _Batch(bits)
                batch.add(doc_id.as_py(), is_train.as_py(), raw)
        if batch.ids:
            yield from _rows_of(batch, part << 32 | k)

    def _rows_of(batch, number):
        for row in batch.rows(number, buckets):
            yield from _rows([row])

    small_batches(spark, 500)
    # the documents, kind 0, are part -1
    sent = base.mapInArrow(read, _SCHEMA).withColumn("part", F.when(F.col("kind") == 0, -1).otherwise(F.col("bucket") % _PARTS))
    sent = scratch.write(sent, by="part")
    small_batches(spark, 32)  # from here on a row is a batch or a bucket
    columns = ["kind", "batch", "bucket", "body"]

    def requests(part: int) -> DataFrame:
        return sent.where(F.col("part") == part).select(*columns)

    def summed(total: np.ndarray):
        at = np.flatnonzero(total)
        yield from _rows([(1, 0, -1, (at, total[at]))])

    def gather(batches):
        bucket, held, size, merged, sums = None, [], 0, 0, np.zeros(2 * ((1 << bits) + PARENTS) + 7)

        def finish():
            words, word, context, count = _merge(held, bits)
            real = count > 0
            used, word = np.unique(word[real], return_inverse=True)
            s = Seating(words[used], word, context[real], count[real], bits)
            n, by_word = s.pairs.n, np.bincount(s.word, s.pairs.n, len(s.words))
            few = [(n == 1).sum(), (n == 2).sum(), (by_word == 1).sum(), (by_word == 2).sum()]
            sums[:] += np.append(s.totals(), few)
            yield from _rows([(0, 0, bucket, s.state())])

        for _, _, b, body in _stream(batches):
            if b != bucket and held:
                yield from finish()
                held, size, merged = [], 0, 0
            bucket = b
            held.append(body)
            size += len(body[2])
            if size > 2 * merged + 1_000_000:
                words, word, context, count = _merge(held, bits)
                held = [(words, np.bincount(word, minlength=len(words)), context, count)]
                size = merged = len(context)
        if held:
            yield from finish()
            yield from summed(sums)

    gathered = []
    for part in range(_PARTS):
        streamed = requests(part).repartition(tasks, "bucket").sortWithinPartitions("bucket", "batch")
        gathered.append(scratch.write(streamed.mapInArrow(gather, _SCHEMA)))
    state, old = reduce(DataFrame.union, gathered), gathered

    def sums(frame: DataFrame) -> np.ndarray:
        def unpack(batches):
            for _, _, _, (at, x) in _stream(batches):
                yield pa.RecordBatch.from_pydict({"at": at, "x": x})

        got = frame.where("kind = 1").mapInArrow(unpack, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(2 * ((1 << bits) + PARENTS) + 7)
        out[got["at"].to_numpy()] = got["x"].to_numpy()
        return out

    first = sums(state)
    total, few = Totals(first, bits), first[-4:]
    pairs, plain = _discount(few[0], few[1]), _discount(few[2], few[3])
    discounts = (plain, (pairs + plain) / 2, pairs)
    n_train, distinct = int(total.c2.sum()), int(total.distinct)
    kept: list[Totals] = []
    for k in range(burn_in + samples):

        def resample(batches, k=k, total=total):
            sums = None
            for kind, _, bucket, body in _stream(batches):
                if kind == 0:
                    s = Seating.of(body)
                    sweep(s, total, discounts, np.random.default_rng([seed, k, bucket]))
                    if k >= burn_in:
                        s.samples.append(_sample(s))
                    sums = s.totals() if sums is None else sums + s.totals()
                    yield from _rows([(0, 0, bucket, s.state(k + 1 < burn_in + samples))])
            if sums is not None:
                yield from summed(sums)

        state = scratch.write(state.mapInArrow(resample, _SCHEMA))
        if distinct:
            total = Totals(sums(state), bits)
        if k >= burn_in:
            kept.append(total)
        scratch.drop(*old)
        old = [state]

    def reply(batches):
        bucket, s, ready = None, None, None
        for kind, batch, b, body in _stream(batches):
            if kind == 0:
                bucket, s, ready = b, Seating.of(body), None
            else:
                if b != bucket:  # no training word in this bucket
                    none = np.zeros(0, np.int64)
                    bucket, s, ready = b, Seating(np.zeros(0, np.uint64), none, none, none, bits), None
                    s.samples = [(none,) * 5] * len(kept)
                ready = ready or prepare(s, kept, discounts)
                logp, count = answer(s, kept, discounts, body, ready)
                yield from _rows([(1, batch, b, (logp.astype(np.float32), count))])

    replies = []
    for part in range(_PARTS):
        both = state.where((F.col("kind") == 0) & (F.col("bucket") % _PARTS == part)).union(requests(part))
        both = both.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind", "batch")
        replies.append(scratch.write(both.mapInArrow(reply, _SCHEMA)))
        scratch.drop_part(sent, "part", part)
    scratch.drop(state)

    def finish(batches):
        docs, logs, counts = None, [], []

        def close():
            ids, is_train, lengths, at, new, pairs = docs
            log, count = np.concatenate(logs).astype(np.float64), np.concatenate(counts)
            count = count[np.cumsum(np.unpackbits(new, count=pairs)) - 1][at]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            plain = np.log10((count + 0.5) / (n_train + 0.5 * (distinct + 1)))
            total = [np.add.reduceat(x, starts) for x in (plain, log[at], (count > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(is_train, pa.bool_()), pa.array(lengths.astype(np.int64)), pa.array(total[2]),
                    pa.array(np.full(len(ids), n_train)), pa.array(total[0]), pa.array(total[1]),
                ],
                names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for kind, _, _, body in _stream(batches):
            if kind == 0:
                if docs:
                    yield from close()
                docs, logs, counts = body, [], []
            else:
                logs.append(body[0])
                counts.append(body[1])
        if docs:
            yield from close()

    joined, results = reduce(DataFrame.union, replies, requests(-1)), []
    for part in range(_PARTS):
        some = joined.where(F.pmod(F.xxhash64("batch"), F.lit(_PARTS)) == part).repartition(tasks, "batch").sortWithinPartitions("batch", "bucket")
        some = some.mapInArrow(
            finish, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        )
        results.append(scratch.write(some))
    scratch.keep(*results)
    return reduce(DataFrame.union, results)


def op9_pitman_yor(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_train", id_remainder(F.col("doc_id"), 5) != 1)
    got = score_texts(docs, "_train")
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
