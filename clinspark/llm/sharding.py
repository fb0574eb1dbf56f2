"""A reproducible shuffle whose shard and slot follow from a row's number: Feistel rounds with cycle walking.

Global row numbers come from ranges of the key: cut points (a bounded list of approximate quantiles) split the rows,
each range is numbered on its own and starts where the ranges before it end. The cut points only balance the work; the
numbers are exact wherever they lie. The text itself is never shuffled.

The permutation of 0..n-1 writes a number as a pair (left, right) of the mixed radix a x b, the least near-square grid
that holds n, runs a fixed number of Feistel rounds over it, and walks on while the result is n or more. Fewer than a
points of the grid are beyond n, so the driver knows the longest walk exactly and the plan unrolls no more than that.
"""

from __future__ import annotations

from collections import Counter
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinspark.llm.common import without

#: Fixed values of the round function: a prime under 2**31, and eight rounds of (multiplier, addend).
PRIME = 2_147_483_647
ROUNDS = 8
SEED = 20_240_607


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    x, out = seed % PRIME or 1, []
    for _ in range(rounds):
        x = x * 48_271 % PRIME
        y = x * 69_621 % PRIME
        out.append((x, y))
        x = y
    return out


def grid(n: int) -> tuple[int, int]:
    """a x b >= n with fewer than a points to spare."""
    a = max(1, isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(x: int, key: tuple[int, int]) -> int:
    t = (x % PRIME * key[0] + key[1]) % PRIME
    return t * t % PRIME * key[0] % PRIME


def feistel(x: int, a: int, b: int, keys: list[tuple[int, int]]) -> int:
    """One pass of the rounds over a number below a * b: the halves take turns."""
    left, right = x // b, x % b
    for i, k in enumerate(keys):
        if i % 2:
            right = (right + _mix(left, k)) % b
        else:
            left = (left + _mix(right, k)) % a
    return left * b + right


def permute(x: int, n: int, seed: int = SEED) -> int:
    """Where row x of n goes."""
    (a, b), keys = grid(n), round_keys(seed)
    x = feistel(x, a, b, keys)
    while x >= n:
        x = feistel(x, a, b, keys)
    return x


def longest_walk(n: int, seed: int = SEED) -> int:
    """Passes beyond the first that any row needs: the longest chain of points beyond n."""
    (a, b), keys = grid(n), round_keys(seed)
    longest = 0
    for x in range(n, a * b):
        steps = 0
        while x >= n:
            x = feistel(x, a, b, keys)
            steps += 1
        longest = max(longest, steps)
    return longest


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """:func:`permute` as a column; ``n`` is known to the driver."""
    (a, b), keys = grid(n), round_keys(seed)
    long = lambda v: F.lit(v).cast("long")

    def one(x: Column) -> Column:
        steps = F.array(*[F.struct(long(m).alias("m"), long(c).alias("c"), F.lit(i % 2 == 1).alias("odd")) for i, (m, c) in enumerate(keys)])
        start = F.struct(F.call_function("div", x, long(b)).alias("l"), (x % long(b)).alias("r"))

        def step(s: Column, k: Column) -> Column:
            half = F.when(k["odd"], s["l"]).otherwise(s["r"]) % long(PRIME)
            t = (half * k["m"] + k["c"]) % long(PRIME)
            t = t * t % long(PRIME) * k["m"] % long(PRIME)
            return F.struct(F.when(k["odd"], s["l"]).otherwise((s["l"] + t) % long(a)).alias("l"), F.when(k["odd"], (s["r"] + t) % long(b)).otherwise(s["r"]).alias("r"))

        return F.aggregate(steps, start, step, lambda s: s["l"] * long(b) + s["r"])

    walk = F.sequence(F.lit(0), F.lit(longest_walk(n, seed)))
    return F.aggregate(walk, number.cast("long"), lambda x, i: F.when((i == 0) | (x >= long(n)), one(x)).otherwise(x))


#: Parts that the rows of a hot key are dealt into, by the hash of their ties.
KEY_PARTS = 16


def numbered(docs: DataFrame, key: str, ties: list[str], out: str = "row_number", range_rows: int = 250_000) -> tuple[DataFrame, int]:
    """``docs`` with 0-based global row numbers in the order of the whole-number ``key``, then ``ties``, and their count.

    Nulls come first. A range has about ``range_rows`` rows, if there are fewer than 4096 ranges by that and more than
    64. A table of fewer distinct keys than ranges has fewer ranges. The rows of a key that fills a range or more, nulls
    included, go by a hash of their ties first, in parts of their own. Rows that are equal in key and ties take the numbers
    of their places in any order. A column named ``out`` is replaced.
    """
    docs = without(docs, out)
    ranges = min(4096, max(64, docs.count() // range_rows))
    quantiles = docs.select(F.percentile_approx(key, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10 * ranges).alias("c")).first()["c"] or []
    cuts = sorted(set(quantiles))
    hot = sorted(k for k, n in Counter(quantiles).items() if n > 1)
    span = F.coalesce(_bucket(F.col(key), cuts), F.lit(-1))
    many = F.col(key).isNull() | F.col(key).isin(hot) if hot else F.col(key).isNull()
    part = F.when(many, F.pmod(F.xxhash64(*ties), F.lit(KEY_PARTS))).otherwise(F.lit(0)) if ties else F.lit(0)
    # A hot key is the last of its range, so its parts follow the range's other rows.
    late = F.col(key).isin(hot) if hot else F.lit(False)
    ranged = docs.withColumns({"__range": span, "__part": F.when(late, part + 1).otherwise(part).cast("int")})
    sizes = sorted((r["__range"], r["__part"], r["n"]) for r in ranged.groupBy("__range", "__part").agg(F.count("*").alias("n")).collect())  # at most KEY_PARTS + 1 rows a range
    before, starts = 0, []
    for r, p, n in sizes:
        starts.append((r, p, before))
        before += n
    w = Window.partitionBy("__range", "__part").orderBy(F.col(key).asc_nulls_first(), *[F.col(t).asc_nulls_first() for t in ties])
    offsets = docs.sparkSession.createDataFrame(starts, "__range int, __part int, __start long")
    placed = ranged.join(F.broadcast(offsets), ["__range", "__part"]).withColumn(out, F.row_number().over(w) - 1 + F.col("__start"))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], out), before


def _bucket(x: Column, cuts: list[int]) -> Column:
    """How many cut points lie below x, by halving."""

    def down(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(cuts[mid]), down(lo, mid)).otherwise(down(mid + 1, hi))

    return F.when(x.isNotNull(), down(0, len(cuts)))


def shard_of(number: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number, without looking at any other row."""
    p = permute(number, n, seed)
    return p % shards, p // shards


def assign(spark: SparkSession, docs: DataFrame, shards: int, key: str = "doc_id", ties: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with row_number, shard and slot; counts of shards are at most one apart, slots have no gaps.

    Columns of these names are replaced. An empty table gives an empty table. Null keys come first; repeated rows have a
    place each.
    """
    docs = without(docs, "shard", "slot")
    rows, n = numbered(docs, key, ties or [])
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    at = rows.withColumn("__to", permuted(F.col("row_number"), n, seed))
    return at.withColumns({"shard": (F.col("__to") % shards).cast("int"), "slot": F.call_function("div", F.col("__to"), F.lit(shards).cast("long"))}).drop("__to")


def op5(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, by the law ``rows``.

    A null text has size 1 and the checksum of an empty text.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = assign(spark, narrow, shards, ties=["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
