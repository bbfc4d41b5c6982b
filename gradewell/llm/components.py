"""Connected components of link tables, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.shared import Scratch


def _ranked(node: str, k: int) -> Column:
    """A node behind its rank in round ``k``: its id in the first round, then a hash that is new in each round."""
    rank = F.xxhash64(F.col(node), F.lit(k)) if k else F.lit(0).cast("long")
    return F.struct(rank.alias("rank"), F.col(node).alias("node"))


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Of ``links`` (a, b): node, component = the least node that links reach; only nodes that have a link.

    Each round every node goes over to the first of itself and its neighbours in
    the round's order, and the links between different nodes that remain are the
    next round's. The last of a component's nodes is never chosen, so each round
    shrinks every component that is left and the rounds end on any graph; in an
    order that is random, the nodes that are left fall by a constant factor in
    expectation, so their number is logarithmic. The first round goes by id,
    because links to a least member then vanish at once. The rounds' choices are
    joined from the last to the first. What is grouped is a minimum, which
    combines before the exchange, and the joins are on plain keys, whose large
    partitions Spark may split: a node with very many links is no large task.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links-0")
    chosen: list[DataFrame] = []
    while not chosen or not edges.isEmpty():
        k = len(chosen)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(_ranked("b", k)).alias("near"))
        went = scratch.keep(near.select(F.col("a").alias("node"), F.least(_ranked("a", k), "near")["node"].alias("label")), f"{name}-{k}")
        chosen.append(went)
        left = edges.join(went.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(went.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        left = left.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        edges = scratch.keep(left, f"{name}-links-{k + 1}")
        scratch.drop(f"{name}-links-{k}")
    labels = chosen.pop()
    while chosen:
        k = len(chosen) - 1
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("later"))
        labels = scratch.keep(chosen.pop().join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label")), f"{name}-whole-{k}")
        scratch.drop(f"{name}-{k}", f"{name}-{k + 1}", f"{name}-whole-{k + 1}")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
