"""Connected components, and connectivity of candidates that share index keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Edges that one task may hold while it looks for components.
FEW_EDGES = 500_000
#: Keys by which a pair of nodes is told to have met already.
_FIRST_KEYS = 8


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable node of every node in ``edges(u, v)``: columns ``node, comp``.

    Alternates the large-star and small-star steps until the graph is a set of stars. Each step is
    a grouped minimum (combined before the shuffle) and a join, so a hub is never held in one task's
    memory; the logarithmic number of rounds is written out, not kept as lineage. Up to ``FEW_EDGES``
    edges, counted first, stay in one partition, so that a round needs no shuffle. No edges: no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    e = scratch.write(e)
    few = e.limit(FEW_EDGES + 1).count() <= FEW_EDGES
    near = lambda df: df.coalesce(1) if few else df
    before = None
    while True:
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1000003)).first()
        if mark == before or not mark[0]:
            break
        before = mark
        ends = F.array(F.struct(F.col("hi").alias("x"), F.col("lo").alias("y")), F.struct(F.col("lo").alias("x"), F.col("hi").alias("y")))
        both = near(e).select(F.explode(ends).alias("e")).select("e.x", "e.y")
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("hi"), F.least("x", "m").alias("lo"))
        large = large.distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi")
        pair = lambda a, b: F.struct(F.col(a).alias("hi"), F.col(b).alias("lo"))
        moved = F.array(pair("hi", "m"), F.when(F.col("lo") != F.col("m"), pair("lo", "m")))
        small = small.select(F.explode(moved).alias("e")).where("e is not null").select("e.hi", "e.lo").distinct()
        old, e = e, scratch.write(small)
        scratch.drop(old)
    ends = F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("comp")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("comp")))
    return scratch.write(near(e).select(F.explode(ends).alias("e")).select("e.node", "e.comp").distinct())


def connect(
    index: DataFrame, fits: Callable[[Column, Column, Column, Column], Column], verify: Callable[[DataFrame], DataFrame], scratch: Scratch, links: DataFrame | None = None,
    sketches: DataFrame | None = None, alike: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Components of the graph whose links are the verified pairs of nodes that share an index key.

    ``index(key, node, about, rank)`` must give every linked pair a common key at which
    ``fits(node, about, other node, other about)`` holds. ``about`` is whatever that filter needs; ``verify(pairs)``
    returns the rows of the written table ``pairs(u, v)`` that are links. ``links(u, v)`` are known ones. Returns ``node, comp`` for nodes
    with a link. ``alike(sketch, other sketch)`` must hold for every linked pair; ``sketches(node, sketch)`` are larger than
    ``about``, and only nodes of keys with several components get theirs. A pair that fits at a key must fit at any other
    that it shares and where neither node's rank is lower.

    A key's nodes aren't all paired. First each key compares its centre, the node of highest rank, with its others;
    a key of m alike nodes costs m comparisons. Then the pairs that aren't connected yet, at keys with nodes of
    several components, are compared if they fit. A pair is skipped only if both ends are connected already,
    so the components are exact. Alike nodes share many keys: each row names the first keys of its node, by rank, that come before
    its own, and a pair with one of them in common doesn't meet again. Of the keys that a pair shares one comes first
    for both or has none before it, so each pair meets at one key at least.
    """
    centre = F.max_by(F.struct("node", "about"), F.struct("rank", "node")).alias("centre")
    groups = index.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), centre).where("a < b")
    live = index.select("key", "node", "about", "rank").join(groups.select("key", "centre"), "key")
    live = scratch.write(live.distinct())
    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    fit = fits(F.col("node"), F.col("about"), F.col("centre.node"), F.col("centre.about"))
    rest = live.where(F.col("node") != F.col("centre.node"))
    first = scratch.write(rest.where(fit).select(*ordered("node", "centre.node")).distinct())
    found = verify(first)
    found = scratch.write(found.select("u", "v") if links is None else found.select("u", "v").union(links.select("u", "v")))
    comp = components(found, scratch)
    known = rest.join(comp, "node", "left").select("key", "node", "about", F.coalesce("comp", "node").alias("c"), (-F.col("rank")).alias("order"))
    known = scratch.write(known)
    mixed = known.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("key")
    mixed = scratch.write(known.join(mixed, "key", "left_semi"))
    place = F.struct("order", "key")
    before = F.transform(F.filter("places", lambda x: x < place), lambda x: x["key"]).alias("before")
    places = mixed.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(place)), 1, _FIRST_KEYS).alias("places"))
    named = mixed.join(places, "node").select("key", "node", "about", "c", before)
    if sketches is not None:
        named = named.join(sketches.select("node", "sketch"), "node").select(*named.columns, "sketch")
    old, mixed = mixed, scratch.write(named)
    scratch.drop(old)
    other = [F.col("key").alias("other_key"), F.col("node").alias("o"), F.col("about").alias("oa"), F.col("c").alias("oc"), F.col("before").alias("ob")]
    fit = fits(F.col("node"), F.col("about"), F.col("o"), F.col("oa"))
    if sketches is not None:
        other.append(F.col("sketch").alias("os"))
        fit = fit & alike(F.col("sketch"), F.col("os"))
    other = mixed.select(*other)
    fit = fit & ~F.arrays_overlap("before", "ob")
    pairs = mixed.join(other, (F.col("key") == F.col("other_key")) & (F.col("node") < F.col("o")) & (F.col("c") != F.col("oc")) & fit)
    pairs = pairs.select(F.col("node").alias("u"), F.col("o").alias("v")).distinct()
    more = scratch.write(verify(scratch.write(pairs.join(first, ["u", "v"], "left_anti"))).select("u", "v"))
    scratch.drop(live, known, mixed)
    if more.isEmpty():
        return comp
    return components(comp.select(F.col("node").alias("u"), F.col("comp").alias("v")).union(more), scratch)
