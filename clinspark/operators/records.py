"""Votes, distributions, validation, linkage and dashboards over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.functions.scalar import js_round, missing_to_null
from clinspark.sources.store import cut_lineage, dealt, stored

TRIAGE = ("RED", "YELLOW", "GREEN", "GRAY", "BLACK")


def rank_of(c: Column, order: Sequence[str]) -> Column:
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out


def search(table: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which any column holds the text, case ignored; a blank text finds all."""
    if not text.strip():
        return table
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.strip().lower()))
    return table.where(hit)


def census(table: DataFrame, ward: str, status: str, done: str) -> DataFrame:
    """ward, total, done and the rounded percentage; no ward is a ward of its own."""
    return (
        table.groupBy(F.coalesce(missing_to_null(F.col(ward)), F.lit("Unassigned")).alias("ward"))
        .agg(F.count("*").alias("total"), F.count_if(F.col(status) == done).alias("done"))
        .withColumn("pct", js_round(100.0 * F.col("done") / F.col("total")))
    )


def fixed_counts(table: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row with a count for each given value; others are dropped, zeros kept."""
    return table.agg(*[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])


def distribution(table: DataFrame, group: str, value: str) -> DataFrame:
    """count, min, max, mean and the elements at floor(n * p) of the sorted values.

    Ranks are counted in a distributed way: values meet pre-aggregated by (group, value), never as one list.
    """
    counts = table.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumns({"upto": F.sum("c").over(w), "n": F.sum("c").over(Window.partitionBy(group))})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1), F.col(value)))
    return ranked.groupBy(group).agg(
        F.sum("c").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"),
        at(0.5).alias("median"), at(0.1).alias("p10"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(0.9).alias("p90"),
    )


def scalar_vote(table: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The value of most weight, then count, then best single weight; ties to the lesser value."""
    per = table.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.max(weight).alias("best"))
    w = Window.partitionBy(*keys).orderBy(F.desc("w"), F.desc("n"), F.desc("best"), value)
    return per.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def list_vote(table: DataFrame, keys: Sequence[str], item: str, weight: str, floor: float = 0.58, share: float = 0.5, cap: int = 6) -> DataFrame:
    """Items seen twice, or heavy enough, or the top one; at most ``cap`` of each key, heaviest first."""
    per = table.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("w"), F.desc("n"), item)
    top = F.max("w").over(Window.partitionBy(*keys))
    kept = per.withColumns({"rank": F.row_number().over(w), "top": top}).where((F.col("n") > 1) | (F.col("w") >= F.greatest(F.lit(floor), share * F.col("top"))) | (F.col("rank") == 1))
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("top")


def best_per_key(table: DataFrame, key: Column, score: str, tie: str) -> DataFrame:
    """For each key the row of the highest score; ties to the lesser value."""
    return table.withColumn("key", key).withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc(score), tie))).where("__r = 1").drop("__r")


def one_to_one(pairs: DataFrame, group: str, left: str, right: str, score: str) -> DataFrame:
    """Greedy matching, best score first (ties by left, then right), each side once.

    A pair is taken if it is the best of both its sides; what is left is matched again. Rounds end when none remains.
    """
    taken = None
    rest = pairs
    while True:
        order = [F.desc(score), F.asc(left), F.asc(right)]
        n = rest.count()
        both = dealt(rest, group, left, n=n).withColumn("__l", F.row_number().over(Window.partitionBy(group, left).orderBy(*order)))
        both = dealt(both, group, right, n=n).withColumn("__r", F.row_number().over(Window.partitionBy(group, right).orderBy(*order)))
        best = cut_lineage(both.where("__l = 1 AND __r = 1").drop("__l", "__r"))
        if best.isEmpty():
            return taken if taken is not None else pairs.limit(0)
        taken = best if taken is None else taken.unionByName(best)
        rest = cut_lineage(rest.join(best.select(group, left), [group, left], "left_anti").join(best.select(group, right), [group, right], "left_anti"))


def validation_errors(rules: Sequence[tuple[str, Column]]) -> Column:
    """The codes of all rules that hold, in order; a null condition doesn't."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules]))


#: Parts that a star of records is built from, so that no task holds all of a hot value.
STAR_PARTS = 64


def stars(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """src and dst: links that connect all rows of equal values, through the least key of each of their parts."""
    part = F.pmod(F.xxhash64(key), F.lit(STAR_PARTS))
    inner = rows.select(*by, key, part.alias("__part")).withColumn("src", F.min(key).over(Window.partitionBy(*by, "__part")))
    heads = rows.select(*by, key, part.alias("__part")).groupBy(*by, "__part").agg(F.min(key).alias(key)).withColumn("src", F.min(key).over(Window.partitionBy(*by)))
    return inner.select("src", F.col(key).alias("dst")).unionByName(heads.select("src", F.col(key).alias("dst"))).where("src <> dst")


def merge_groups(nodes: DataFrame, key: str, edges: DataFrame, rounds: int = 40) -> DataFrame:
    """key and group, the least key that is reachable over the edges: minima spread and jump until nothing changes."""
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = nodes.select(F.col(key).alias("node"), F.col(key).alias("group"))
    labels = stored(labels)
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("group").alias("near"))
        step = labels.join(near, labels["node"] == near["src"], "left").select("node", F.least("group", F.coalesce("near", "group")).alias("group"))
        jump = stored(step.alias("a").join(step.alias("b"), F.col("a.group") == F.col("b.node")).select(F.col("a.node").alias("node"), F.least("a.group", "b.group").alias("group")))
        changed = jump.alias("n").join(labels.alias("o"), "node").where("n.group <> o.group").limit(1).count()
        labels = jump
        if not changed:
            return labels.select(F.col("node").alias(key), "group")
    raise RuntimeError("groups didn't settle")
