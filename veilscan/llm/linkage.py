"""Connected groups of rows that share a bucket and pass a check, without emitting all pairs.

Buckets of near copies can hold a third of all rows, so members are first held
against one pivot per bucket (linear in the members). What the pivot links is
contracted, buckets of two or inside one component are done, and the rest meets up to
``PIVOTS`` others of different components. Only members of a bucket whose
components still differ are then paired, under a cheap predicate inside the
join, so no link is lost; a large bucket is dealt out in cells of pairs, so none
of them is one task. A bucket has at most ``PARTS`` parts, whatever its size: its
members are repeated at most so often, and the rows grow with the members.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Store

#: Members of a part of a bucket, in buckets of up to PARTS parts; a larger bucket has larger ones.
CELL, PARTS = 256, 16
#: Pivots of a bucket after the first round.
PIVOTS = 4


def components(store: Store, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over the links (a, b).

    Every round hooks each node to its smallest neighbour, halves the paths to
    the roots until they are stars, and contracts the links; a node's
    neighbours are reduced by a combined aggregate, so hubs are no hot task.
    """
    edges = store.save(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                       .distinct(), "links")
    labels = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = store.save(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                            .select("id", F.least("id", "m").alias("root")), "parents")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("grand"))
            jumped = store.save(parent.join(up, "root").select("id", F.col("grand").alias("root"),
                                                              (F.col("grand") != F.col("root")).alias("moved")), "parents")
            store.drop(parent)
            parent = jumped
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select("id", F.col("root").alias("component"))
            kept = parent
        else:
            step = parent.select(F.col("id").alias("component"), "root")
            new = store.save(labels.join(step, "component", "left")
                             .select("id", F.coalesce("root", "component").alias("component")), "labels")
            store.drop(kept)
            labels = kept = new
        to_a = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        to_b = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = store.save(edges.join(to_a, "a").join(to_b, "b").filter("ra <> rb")
                          .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        store.drop(edges)
        edges = rest
        if rest.isEmpty():
            return labels


def merged(store: Store, labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) after further links (a, b): only components are linked anew."""
    if labels is None:
        return components(store, links)
    name = {c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"}
    between = links.join(name["a"], "a", "left").join(name["b"], "b", "left")
    step = components(store, between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    step = step.select(F.col("id").alias("old"), F.col("component").alias("root"))
    known = labels.join(step, F.col("component") == F.col("old"), "left").select("id", F.coalesce("root", "component").alias("component"))
    new = step.join(labels, F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("root").alias("component"))
    return store.save(known.unionAll(new), "labels")


def cells(full: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two sides whose join on (key, lo, hi) holds each pair of one bucket: (a, ca, the columns), and (b, cb, the columns)."""
    sizes = full.groupBy("key").agg(F.count("*").alias("n"))
    parts = F.least(F.ceil(F.col("n") / CELL), F.lit(PARTS)).cast("int")
    full = (full.join(sizes, "key").withColumn("parts", parts)
            .withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")))
    x = full.select("key", F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("hi"),
                    F.col("id").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"{c}_a") for c in cols])
    y = full.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("lo"), F.col("own").alias("hi"),
                    F.col("id").alias("b"), F.col("component").alias("cb"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return x, y


def linked(store: Store, members: DataFrame, payload: DataFrame, near: Callable[[Callable, Callable], Column],
           confirm: Callable[[DataFrame], DataFrame], prepare: Callable[[DataFrame], None] | None = None,
           pivot_rounds: int = 2) -> DataFrame | None:
    """(id, component) of the ids that have a link, or None where nothing has.

    ``members`` (key, id) puts ids into buckets; ``payload`` has one row per id
    with the columns that ``near`` compares: it gets two functions from column
    name to column and returns a cheap predicate that holds for every pair to
    be linked. ``confirm`` takes distinct pairs (a, b) and returns the linked ones;
    ``prepare`` is first given the ids (id) that share any bucket.
    """
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = store.save(members.join(shared, "key"), "members")
    if prepare:
        prepare(members.select("id").distinct())
    popular = members.groupBy("id").agg(F.sum("n").alias("rank"))
    open_ = members.select("key", "id").join(popular, "id").select("key", "id", "rank", F.col("id").alias("component"))
    labels = None
    cols = [c for c in payload.columns if c != "id"]
    for r in range(pivot_rounds + 1):
        if r:
            # the one pair of a bucket of two has met already
            members = members.filter("n > 2") if r == 1 else members
            named = (members.select("key", "id", F.col("id").alias("component")) if labels is None else
                     members.select("key", "id").join(labels, "id", "left")
                     .select("key", "id", F.coalesce("component", "id").alias("component")))
            open_ = named.withColumn("rank", F.xxhash64("id", F.lit(r)))
            mixed = (open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                     .filter("lo <> hi").select("key"))
            open_ = open_.join(mixed, "key", "left_semi")
        open_ = store.save(open_, "open")
        if open_.isEmpty():
            break
        if r < pivot_rounds:
            slot = F.pmod(F.xxhash64("component"), F.lit(PIVOTS if r else 1))
            pivot = (open_.groupBy("key", slot.alias("slot")).agg(F.max(F.struct("rank", "id", "component")).alias("p"))
                     .select("key", F.col("p.id").alias("pivot"), F.col("p.component").alias("pc")))
            pairs = (open_.join(pivot, "key").filter("component <> pc")
                     .select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct())
            left = payload.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
            right = payload.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
            pairs = pairs.join(left, "a").join(right, "b").filter(near(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))
        else:
            x, y = cells(open_.join(payload, "id"), cols)
            pairs = (x.join(y, ["key", "lo", "hi"]).filter((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b")))
                     .filter((F.col("ca") != F.col("cb")) & near(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b")))
                     .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        pairs = store.save(pairs.select("a", "b").distinct(), "pairs")
        found = store.save(confirm(pairs), "found")
        store.drop(pairs, open_)
        if not found.isEmpty():
            labels = merged(store, labels, found)
    return labels
