"""Made-up training data by counters: every draw is a hash of a row's key and a name, so partitions and retries change nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(key: Column, salt: str | Column) -> Column:
    """A number from 0 up to 1, by the first 32 bits of the MD5 of ``salt:key``."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.conv(F.substring(F.md5(F.concat(salt, F.lit(":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw(key: Column, salt: str, weights: Mapping[str, float]) -> Column:
    """One of the values, each as often as its weight says: the inverse of their distribution at :func:`unit`."""
    total, below, u = sum(weights.values()), 0.0, unit(key, salt)
    out = None
    for value, weight in weights.items():
        below += weight
        out = F.when(u < below / total, value) if out is None else out.when(u < below / total, value)
    if out is None:
        raise ValueError("no values to draw from")
    return out.otherwise(list(weights)[-1])


def misread(text: Column, key: Column, rate: Column, seen: str, read: str) -> Column:
    """Words whose hash falls below ``rate``, with look-alikes (characters of ``seen`` as those of ``read``)."""
    words = F.split(text, " ", -1)
    return F.array_join(F.transform(words, lambda w, i: F.when(unit(key, F.concat(F.lit("w"), (i + 1).cast("string"))) < rate, F.translate(w, seen, read)).otherwise(w)), " ")


def lab_reports(people: DataFrame, key: str, name: str, tests: Sequence[tuple[str, str, int, int]], diagnoses: Mapping[str, float], least: float = 0.05, most: float = 0.25) -> DataFrame:
    """key, truth and garbled: a report for each person; tests are (name, unit, low, high), limits in tenths.

    A test is in three of five reports; its value lies up to a third outside the limits.
    """
    k = F.col(key)
    tenths = lambda c: F.concat(F.floor(c / 10).cast("string"), F.lit("."), (c % 10).cast("string"))

    def line(test: str, u: str, low: int, high: int) -> Column:
        a, b = low - low // 3, high + high // 3
        value = (F.lit(a) + F.floor(unit(k, test) * (b - a + 1))).cast("long")
        text = F.concat(F.lit(f"{test}: "), tenths(value), F.lit(f" {u} (Ref: {low // 10}.{low % 10}-{high // 10}.{high % 10})"))
        return F.when(unit(k, f"has {test}") < 0.6, text)

    head = [F.concat(F.lit("Patient: "), F.coalesce(F.col(name), F.lit(""))), F.concat(F.lit("Age: "), (F.lit(18) + F.floor(unit(k, "age") * 73)).cast("string")), F.concat(F.lit("Diagnosis: "), draw(k, "dx", diagnoses))]
    rows = people.select(k.alias("key"), F.concat_ws("\n", *head, *[line(*t) for t in tests]).alias("truth"))
    return rows.withColumn("garbled", misread(F.col("truth"), F.col("key"), F.lit(least) + unit(F.col("key"), "rate") * (most - least), "olesB", "01358"))


def variants(words: DataFrame, word: str = "word", count: int = 20) -> DataFrame:
    """word, rank (from 1) and variant: up to ``count`` different slips of each different word of two characters or more.

    Three times as many slips are tried; each replaces, loses or doubles the character at a place, all by hash.
    """
    w, letters = F.col("word"), F.lit("abcdefghijklmnopqrstuvwxyz")

    def slip(h: Column) -> Column:
        number = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
        p = (number(1) % F.length(w)).cast("int")
        c, op = F.substring(w, p + 1, F.lit(1)), number(9) % 3
        new = F.when(op == 0, F.substring(letters, (number(17) % 26 + 1).cast("int"), F.lit(1))).when(op == 1, F.lit("")).otherwise(F.concat(c, c))
        return F.concat(F.substring(w, F.lit(1), p), new, F.substring(w, p + 2, F.length(w)))

    # A word's slips depend on it alone, so they need no shuffle; few words give many rows, so they are dealt out first.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = words.select(F.col(word).alias("word")).where(F.length("word") >= 2).distinct().repartition(parts, "word")
    hashes = F.transform(F.sequence(F.lit(1), F.lit(3 * count)), lambda j: F.md5(F.concat(w, F.lit(":"), j.cast("string")).cast("binary")))
    made = different.withColumn("h", hashes).withColumn("v", F.array_distinct(F.transform("h", slip)))
    return made.select("word", F.posexplode(F.slice(F.filter("v", lambda v: v != w), 1, count)).alias("r", "variant")).select("word", (F.col("r") + 1).alias("rank"), "variant")
