"""Connected components by alternating large-star and small-star, and links between the members of buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm._common import Saved, Scope


def _nearest(edges: DataFrame) -> DataFrame:
    """Each end of the directed edges (u, v) with the smallest of itself and its neighbours; a sum, not a list."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id that has a link; links has columns a and b.

    Each round hangs a vertex's larger neighbours, then its smaller ones and itself, on the smallest vertex it knows;
    the edges shrink to stars around the components' smallest ids in about log^2 rounds. Neighbours are met by joins
    and minima only, so that a vertex with very many neighbours is never gathered. Null ids and loops are ignored.
    """
    edges = Saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    told = None
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        hung = Saved(large, "star")
        near = _nearest(hung.df)
        small = hung.df.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        after = Saved(small.where("u <> v").distinct(), "star")
        edges.drop(), hung.drop()
        edges, last = after, told
        told = edges.df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if told == last:
            break
    stars = edges.df.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).distinct()


def with_component(ids: DataFrame, id: str, components: DataFrame) -> DataFrame:
    """ids with `component`, its own id where it has no link."""
    named = components.select(F.col("id").alias("__id"), F.col("component"))
    return ids.join(named, ids[id] == named["__id"], "left").withColumn("component", F.coalesce("component", F.col(id))).drop("__id")


def bucket_components(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], name: str, confirm_mixed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Components of the links that `confirm` finds among candidates: pairs of ids that share a bucket.

    members: bucket and id. confirm: from distinct pairs (a, b) to those that are links. No link between two
    components is lost, yet a bucket's pairs are not all made: first every member meets the bucket's smallest id;
    then, of the buckets that still hold several components, the members outside the bucket's largest component meet
    the members of other components. Pairs that are in one component already need no check. confirm_mixed, if given,
    finds the links of such buckets from their members (bucket, id, component and most, the largest component).
    """
    heads = members.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("tail")).where("head <> tail")
    shared = Saved(members.join(heads.drop("tail"), "bucket").distinct(), f"{name}-buckets")
    first = Saved(confirm(shared.df.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()), f"{name}-links")
    components = Saved(connected_components(first.df), f"{name}-components")
    placed = with_component(shared.df.select("bucket", "id"), "id", components.df)
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("k")).where("k > 1").drop("k")
    placed = Saved(placed.join(mixed, "bucket"), f"{name}-placed")
    second = Saved(confirm_mixed(placed.df) if confirm_mixed else confirm(mixed_pairs(placed.df)), f"{name}-links")
    out = Saved(connected_components(first.df.unionByName(second.df)), f"{name}-components")
    for old in (shared, placed, first, second, components):
        old.drop()
    return out.df


def mixed_pairs(placed: DataFrame) -> DataFrame:
    """The distinct pairs of members of one bucket and two components, one of the bucket's largest or smaller by id."""
    few = placed.where("component <> most").select("bucket", F.col("id").alias("x"), F.col("component").alias("cx"))
    every = placed.select("bucket", F.col("id").alias("y"), F.col("component").alias("cy"), "most")
    pairs = few.join(every, "bucket").where("cx <> cy and (cy = most or x < y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def mixed_blocks(placed: DataFrame, payload: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks that together hold the pairs of mixed_pairs: bucket, most, few and every (lists of about
    `block` members with their component and payload, a struct by id). Rows grow with the blocks, not with the pairs."""
    own = placed.join(payload, "id").withColumn("member", F.struct("id", "component", "payload"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.expr("component <> most")).alias("n_few"))
    own = own.join(sizes, "bucket")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col(n) / block))
    few = own.where("component <> most").groupBy("bucket", part("n_few", 1).alias("block")).agg(F.collect_list("member").alias("few"))
    every = own.groupBy("bucket", part("n", 2).alias("block")).agg(F.collect_list("member").alias("every"), F.first("most").alias("most"))
    return few.drop("block").join(every.drop("block"), "bucket").select("bucket", "most", "few", "every")
