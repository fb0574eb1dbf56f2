"""Distributed connected components: hubs pull in, then point to the root; rounds written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.common import few_files, remove, written

MAX_ROUNDS = 60
def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (src, dst); the component is the least node of its own.

    Each round has two steps. Large: every node points its larger neighbours to the least node it knows (its own
    included). Small: every node points its smaller neighbours, and itself, to the least of them. Both keep the
    components, and the edges end as stars around the least nodes, in about the logarithm of the longest path. A hub's
    rows are never gathered: minima pre-aggregate, and are written, so that both sides of a join are plain tables and the
    rows of a hub are split at run time. Null and self edges are
    dropped (a node that has only self edges is a component of its own).
    """
    clean = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    nodes, _ = written(spark, few_files(clean.select(F.explode(F.array("src", "dst")).alias("node")).distinct()), "nodes")
    pairs = clean.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    current, path = written(spark, few_files(pairs), "edges")
    before = _state(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # Large step. u > v: each edge seen from both ends.
        both = current.select(F.col("u").alias("n"), F.col("v").alias("m")).union(current.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least, least_at = written(spark, few_files(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))), "minima")
        large, large_at = written(spark, few_files(both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("r").alias("v")).distinct()), "large")
        # Small step: u keeps its least neighbour, and hands it to the others.
        root, root_at = written(spark, few_files(large.groupBy("u").agg(F.min("v").alias("r"))), "minima")
        small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("r").alias("v")), F.struct("u", F.col("r").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new, at = written(spark, few_files(small), "edges")
        state = _state(new)
        for gone in (path, least_at, large_at, root_at):
            remove(spark, gone)
        current, path = new, at
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't settle")
    return nodes.join(current.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Number and order-free sums of the edges: equal once a round changes nothing."""
    r = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.shiftright(F.xxhash64("u", "v"), 12))).first()
    return tuple(r)
