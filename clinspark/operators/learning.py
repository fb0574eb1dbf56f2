"""Learning from reviewed corrections, calibration, classifiers and accuracy metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vocabulary(tokens: DataFrame, token: str, ts: str | None = None) -> DataFrame:
    """word (lower case), n, its commonest spelling (ties to the lesser), and when it was last seen."""
    seen = tokens.where(F.col(token) != "").groupBy(F.lower(F.col(token)).alias("word"), F.col(token).alias("variant")).agg(F.count("*").alias("c"), *([F.max(ts).alias("last")] if ts else []))
    w = Window.partitionBy("word").orderBy(F.desc("c"), "variant")
    ranked = seen.withColumn("r", F.row_number().over(w))
    return ranked.groupBy("word").agg(F.sum("c").alias("n"), F.max(F.when(F.col("r") == 1, F.col("variant"))).alias("preferred"), *([F.max("last").alias("last_seen")] if ts else []))


def char_confusions(pairs: DataFrame, truth: str, seen: str, limit: int = 100, diagonal: bool = False) -> DataFrame:
    """truth_char, seen_char, n at equal positions of the first ``limit`` characters."""
    n = F.least(F.length(truth), F.length(seen), F.lit(limit))
    at = pairs.where(n > 0).select(F.col(truth).alias("t"), F.col(seen).alias("s"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    chars = at.select(F.substring("t", F.col("i"), F.lit(1)).alias("truth_char"), F.substring("s", F.col("i"), F.lit(1)).alias("seen_char"))
    return (chars if diagonal else chars.where("truth_char <> seen_char")).groupBy("truth_char", "seen_char").agg(F.count("*").alias("n"))


def pair_counts(table: DataFrame, group: str, item: str) -> DataFrame:
    """a < b and in how many groups both occur; groups' distinct items meet in a join on the group."""
    d = table.select(F.col(group).alias("g"), F.col(item).alias("a")).where("g IS NOT NULL AND a IS NOT NULL").distinct()
    return d.join(d.withColumnRenamed("a", "b"), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def context_chains(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """context (field:value), target field, its value and count, for all ordered pairs of different fields."""
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v"))) for f in fields]))
    a = records.select(F.monotonically_increasing_id().alias("id"), present.alias("p"))
    pairs = a.select(F.explode("p").alias("c"), "p").select("c", F.explode("p").alias("t")).where("c.f <> t.f")
    return pairs.groupBy(F.concat_ws(":", "c.f", "c.v").alias("context"), F.col("t.f").alias("target"), F.col("t.v").alias("value")).agg(F.count("*").alias("n"))


def corrections(table: DataFrame, seen: str, truth: str, ts: str) -> DataFrame:
    """For each text as seen: how often it was corrected, the latest truth and the commonest one."""
    per = table.groupBy(seen, truth).agg(F.count("*").alias("c"), F.max(ts).alias("last"))
    return per.groupBy(seen).agg(F.sum("c").alias("n"), F.max_by(truth, F.struct("last", truth)).alias("latest"), F.max_by(truth, F.struct("c", truth)).alias("commonest"))


def frequency_boost(n: Column) -> Column:
    return F.log1p(n) / math.log(101)


def context_boost(n: Column) -> Column:
    return 0.3 * F.log1p(n)


def reliability(table: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """bin, n, mean score and accuracy; null scores are left out."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return table.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("confidence"), F.avg(F.col(truth).cast("double")).alias("accuracy"))


def calibration_error(diagram: DataFrame) -> DataFrame:
    return diagram.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def platt(table: DataFrame, score: str, truth: str, rounds: int = 100, least: int = 30) -> tuple[float, float] | None:
    """Slope and intercept of a logistic fit with smoothed targets; null below ``least`` rows.

    Rows meet as counts by (score, truth): each Newton step is one aggregate over them, whatever the table's size.
    """
    rows = table.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(score).alias("s"), F.col(truth).cast("int").alias("y")).agg(F.count("*").alias("n")).cache()
    total = rows.agg(F.sum("n"), F.sum(F.col("n") * F.col("y"))).first()
    if not total[0] or total[0] < least:
        rows.unpersist()
        return None
    pos, neg = total[1], total[0] - total[1]
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    counts, rows = rows, rows.withColumn("t", F.when(F.col("y") == 1, hi).otherwise(lo))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col("s") + F.lit(b))))
        w, e = F.col("n") * p * (1 - p), F.col("n") * (p - F.col("t"))
        g1, g0, h11, h10, h00 = rows.agg(F.sum(e * F.col("s")), F.sum(e), F.sum(w * F.col("s") * F.col("s")), F.sum(w * F.col("s")), F.sum(w)).first()
        h11, h00 = h11 + 1e-9, h00 + 1e-9
        det = h11 * h00 - h10 * h10
        da, db = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    counts.unpersist()
    return a, b


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds and values of the non-decreasing fit to means y with counts n at ascending x."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n, strict=True):
        blocks.append([xi, yi, ni])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b = blocks.pop()
            a = blocks[-1]
            a[1] = (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2])
            a[2] += b[2]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def isotonic(table: DataFrame, field: str, score: str, truth: str, digits: int = 3) -> DataFrame:
    """field, x and y of the fit, over scores rounded to ``digits``, so a field's group is bounded."""
    binned = table.where(F.col(score).isNotNull()).groupBy(F.col(field).alias("field"), F.round(F.col(score), digits).alias("x")).agg(F.avg(F.col(truth).cast("double")).alias("y"), F.count("*").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        x, y = pool_adjacent(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["n"].to_numpy(dtype=float))
        return pd.DataFrame({"field": rows["field"].iat[0], "x": x, "y": y})

    return binned.groupBy("field").applyInPandas(fit, f"field {dict(table.dtypes)[field]}, x double, y double")


def gaussian_landscape(table: DataFrame, label: str, vector: str) -> DataFrame:
    """label, dim, n, mean and variance: variance 2 from a single example, never below 0.1 over the root of n."""
    at = table.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("dim", "x"))
    g = at.groupBy("label", "dim").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("mean"), F.var_pop(F.col("x").cast("double")).alias("v"))
    return g.select("label", "dim", "n", "mean", F.when(F.col("n") == 1, 2.0).otherwise(F.greatest("v", 0.1 / F.sqrt("n"))).alias("variance"))


#: Labels that a model of classes may have; every row is scored against each.
MOST_LABELS = 10_000


def against_labels(table: DataFrame, model: DataFrame) -> DataFrame:
    """Every row with every row of a model of one row a label; a model beyond ``MOST_LABELS`` is refused."""
    labels = [r["label"] for r in model.select("label").limit(MOST_LABELS + 1).collect()]
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    each = F.explode(F.array(*[F.lit(x) for x in labels])) if labels else F.explode(F.array().cast("array<string>"))
    return table.withColumn("label", each).join(F.broadcast(model), "label")


def classify_landscape(table: DataFrame, key: str, vector: str, model: DataFrame) -> DataFrame:
    """key, predicted label, score, confidence (margin over range, 0 to 1) and the largest deviation from the winner.

    The model is as small as labels times dimensions: arrays, one row for each label, of which there may be ``MOST_LABELS``.
    """
    packed = model.groupBy("label").agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean", "variance"))), lambda s: F.struct(s["mean"].alias("m"), s["variance"].alias("v"))).alias("p"))
    z = F.zip_with(F.col(vector), "p", lambda x, p: (x.cast("double") - p["m"]) * (x.cast("double") - p["m"]) / (p["v"] + 1e-8))
    deviation = F.zip_with(F.col(vector), "p", lambda x, p: F.abs(x.cast("double") - p["m"]) / F.sqrt(p["v"] + 1e-8))
    scored = against_labels(table.select(key, vector), packed).select(key, "label", (-0.5 * F.aggregate(z, F.lit(0.0), lambda a, x: a + x) + 0.5 * F.log(F.col("n") + 1)).alias("score"), F.array_max(deviation).alias("max_z"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "label")
    ranked = scored.withColumn("r", F.row_number().over(w))
    best = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    return ranked.groupBy(key).agg(
        best("label", 1).alias("predicted"), best("score", 1).alias("score"), best("max_z", 1).alias("rejection"),
        F.least(F.greatest((best("score", 1) - best("score", 2)) / F.nullif(F.max("score") - F.min("score"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )


def weighted_l1(a: Column, b: Column, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    terms = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), w, lambda d, k: d * k)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
