"""Fuzzy joins that grow with their input: equi joins on segments or forms of words, an exact distance after the join.

Segments: a term is cut into k + 1 segments; within k edits one of them stays as it is, at a place that can move only as far
as the edits before and after it allow. Terms of one length are cut where their characters differ from each other, so that
each segment tells about as much as the others: what all share (a common prefix) is no key of its own.

Forms: two words within k edits have a common form after at most k deletions from each. A word of n letters has about
n**k / k! forms, which suits short words.

Patterns: of what edits make of two words, a replaced letter leaves an open place in both, an added or lost one goes from the
word that has it. Words of one pattern are so many edits apart at most, so where only the nearest is asked for, a pattern
keeps its least term, and the work doesn't grow with the number of near terms. The characters that all terms start with are
no part of a pattern.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.sources.store import cut_lineage


def _shorter(text: Column) -> Column:
    """All forms of a text with one character less."""
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def forms(text: Column, edits: int) -> Column:
    """Hashes of a text's different forms with at most so many characters less."""
    level = F.array(text)
    every = [level]
    for _ in range(edits):
        level = F.array_distinct(F.flatten(F.transform(level, _shorter)))
        every.append(level)
    return F.transform(F.array_distinct(F.flatten(F.array(*every))), lambda x: F.xxhash64(x))


def near_pairs(left: DataFrame, token: str, right: DataFrame, term: str, edits: int) -> DataFrame:
    """token, term and distance of all pairs of different values within ``edits``; nulls take no part."""
    l = left.select(token).where(F.col(token).isNotNull()).distinct()
    r = right.select(term).where(F.col(term).isNotNull()).distinct()
    if edits == 0:
        return l.join(r, F.col(token) == F.col(term)).withColumn("distance", F.lit(0))
    keyed = lambda t, c: t.select(c, F.explode(forms(F.col(c), edits)).alias("__form"))
    pairs = keyed(l, token).join(keyed(r, term), "__form").select(token, term).distinct()
    return pairs.withColumn("distance", F.levenshtein(F.col(token), F.col(term), edits)).where("distance >= 0")


#: Different characters of a lexicon that plans hold.
MOST_LETTERS = 1000
#: Terms of up to so many characters are cut by what their places tell, longer ones into segments of one size.
LONGEST = 128


def balanced_cuts(told: list[float], parts: int) -> list[int]:
    """Where ``parts`` segments start, none empty, so that each has about the same share of what the places tell."""
    total, passed, starts = sum(told), told[0], [0]
    for p in range(1, len(told)):
        if len(starts) < parts and (passed >= total * len(starts) / parts or len(told) - p == parts - len(starts)):
            starts.append(p)
        passed += told[p]
    return starts


def segment_cuts(terms: DataFrame, term: str, edits: int) -> DataFrame:
    """length, part, start and size of the segments of terms of each length up to ``LONGEST``: at most LONGEST * (edits + 1) rows."""
    sized = terms.select(term, F.length(term).alias("length")).where(F.col("length").between(edits + 1, LONGEST))
    letters = sized.select("length", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.substring(F.col(term), i, F.lit(1)))).alias("place", "letter"))
    counts = letters.groupBy("length", "place", "letter").agg(F.count("*").alias("n"))
    told = counts.groupBy("length", "place").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("told"))
    by: dict[int, dict[int, float]] = {}
    for length, place, value in told.collect():  # at most LONGEST squared
        by.setdefault(length, {})[place] = value + 0.01
    rows = []
    for length, places in sorted(by.items()):
        starts = balanced_cuts([places[p] for p in range(length)], edits + 1)
        rows += [(length, i, a, b - a) for i, (a, b) in enumerate(zip(starts, [*starts[1:], length], strict=True))]
    return terms.sparkSession.createDataFrame(rows, "length int, part int, start int, size int")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all tasks by ``by``: joins that compute much from few bytes would else run in the one task that these fill."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def segment_pairs(left: DataFrame, token: str, right: DataFrame, term: str, edits: int) -> DataFrame:
    """token, term and distance of all pairs of different values within ``edits``, by segments; nulls take no part."""
    l = spread(left.select(token).where(F.col(token).isNotNull()), token).distinct()
    r = cut_lineage(right.select(term).where(F.col(term).isNotNull()).distinct())
    if edits == 0:
        return l.join(r, F.col(token) == F.col(term)).withColumn("distance", F.lit(0))
    k = F.lit(edits)
    cuts = F.broadcast(segment_cuts(r, term, edits))
    parts = F.explode(F.sequence(F.lit(0), k)).alias("part")

    def with_cuts(rows: DataFrame) -> DataFrame:
        """Start and size of each part, from the table or, for longer terms, in even steps."""
        even = lambda i: F.floor(i * F.col("length") / (edits + 1)).cast("int")
        kept = [c for c in rows.columns if c not in ("length", "part")]
        return rows.join(cuts, ["length", "part"], "left").select(*kept, "length", "part", F.coalesce("start", even(F.col("part"))).alias("start"), F.coalesce("size", even(F.col("part") + 1) - even(F.col("part"))).alias("size"))

    held = with_cuts(r.select(term, F.length(term).alias("length"), parts).where(F.col("length") > k))
    held = held.select(term, "length", "part", F.substring(F.col(term), F.col("start") + 1, F.col("size")).alias("segment"))
    n = F.length(token)
    asked = l.select(token, F.explode(F.sequence(F.greatest(n - k, k + 1), F.greatest(n + k, k + 1))).alias("length")).select("*", parts)
    asked = with_cuts(asked)
    more = n - F.col("length")
    low, high = F.greatest(-F.col("part"), more - k + F.col("part")), F.least(F.col("part"), more + k - F.col("part"))
    moves = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    asked = asked.select(token, "length", "part", "start", "size", F.explode(moves).alias("move")).where((F.col("start") + F.col("move") >= 0) & (F.col("start") + F.col("move") + F.col("size") <= n))
    asked = asked.select(token, "length", "part", F.substring(F.col(token), F.col("start") + F.col("move") + 1, F.col("size")).alias("segment"))
    # Measured where they meet: only what is near enough is made distinct.
    met = asked.join(held, ["length", "part", "segment"]).select(token, term, F.levenshtein(F.col(token), F.col(term), edits).alias("distance"))
    found = met.where("distance >= 0").distinct()
    # Terms without enough characters for as many segments, and what is as short.
    return found.unionByName(near_pairs(l.where(n <= 2 * edits), token, r.where(F.length(term) <= edits), term, edits))


#: Terms with up to so many characters after those that all begin with are met by patterns, longer ones by segments.
PATTERN_LENGTH = 12


def patterns(rows: DataFrame, text: str, opened: int, dropped: int) -> DataFrame:
    """``rows`` with pattern, for each way to open so many places of ``text`` and to drop so many others: the open places, and what is left."""
    found = []
    for kinds in sorted(set(permutations("o" * opened + "d" * dropped))):
        made, last, kept, open_at = rows, F.lit(0), [], []
        for i, kind in enumerate(kinds):
            at = f"__at{i}"
            made = made.withColumn(at, F.explode(F.when(last < F.length(text), F.sequence(last + 1, F.length(text)))))
            kept.append(F.substring(F.col(text), last + 1, F.col(at) - last - 1))
            if kind == "o":
                open_at.append(F.col(at) - kinds[:i].count("d"))
            last = F.col(at)
        kept.append(F.substring(F.col(text), last + 1, F.length(text)))
        found.append(made.select(*rows.columns, F.concat(F.concat_ws(",", *open_at), F.lit("|"), *kept).alias("pattern")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _least_by_pattern(tokens: DataFrame, token: str, terms: DataFrame, term: str, head: Column, heads: list[tuple[int, int, int]], lengths: tuple[int, int], edits: int) -> DataFrame:
    """token, term and distance: of each token without a term nearer than ``edits``, the least terms of its patterns at exactly so many.

    ``head``: how many of the characters that all terms begin with a token has, these go from both; ``heads``: each such
    number with the least and the most characters of its tokens. ``lengths``: the least and the most characters of a term.
    """
    cut = lambda c, h: F.substring(F.col(c), h + 1, F.length(c)).alias("rest")
    asked = spread(tokens.select(token, head.alias("head")), token).select(token, "head", cut(token, F.col("head")))
    held = spread(terms, term).select(term, F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(h, ("head", "least", "most"), strict=True)]) for h in heads])).alias("h"))
    held = held.select(term, F.col("h.head").alias("head"), F.col("h.least").alias("least"), F.col("h.most").alias("most"), cut(term, F.col("h.head"))).where(F.length("rest") <= PATTERN_LENGTH)
    longest = F.least(F.lit(lengths[1]), F.col("head") + PATTERN_LENGTH)
    asks, holds = [], []
    for opened in range(edits + 1):
        for lost in range(edits + 1 - opened):
            added = edits - opened - lost  # characters that only the term has
            if not any(least - lost + added <= lengths[1] and most - lost + added >= lengths[0] for _, least, most in heads):
                continue
            kind = F.lit(opened * (edits + 1) + lost)
            fit = (F.length(token) - lost + added).between(F.lit(lengths[0]), longest)
            asks.append(patterns(asked.where(fit), "rest", opened, lost).select(token, "head", kind.alias("kind"), "pattern"))
            fit = (F.length(term) + lost - added).between(F.col("least"), F.col("most"))
            holds.append(patterns(held.where(fit), "rest", opened, added).select(term, "head", kind.alias("kind"), "pattern"))
    if not asks:
        return tokens.select(token, F.col(token).alias(term), F.lit(edits).alias("distance")).limit(0)
    for more in asks[1:]:
        asks[0] = asks[0].unionByName(more)
    for more in holds[1:]:
        holds[0] = holds[0].unionByName(more)
    by = ["head", "kind", "pattern"]
    return asks[0].join(holds[0].groupBy(*by).agg(F.min(term).alias(term)), by).select(token, term, F.lit(edits).alias("distance"))


def nearest_terms(tokens: DataFrame, token: str, lexicon: DataFrame, term: str, limit: int) -> DataFrame:
    """token, term and distance of the nearest term within ``limit`` edits of each different token; ties to the lesser term.

    Exact terms first; only tokens without one look one edit further, and so on, so most need few patterns.
    """
    terms = cut_lineage(lexicon.select(term).where(F.col(term).isNotNull()).distinct())
    first, last, shortest, longest = terms.agg(F.min(term), F.max(term), F.min(F.length(term)), F.max(F.length(term))).first()
    shared = os.path.commonprefix([first or "", last or ""])[:LONGEST]
    head = F.coalesce(*[F.when(F.col(token).startswith(shared[:i]), F.lit(i)) for i in range(len(shared), 0, -1)], F.lit(0))

    def found(rest: DataFrame, e: int) -> DataFrame:
        if e == 0 or first is None:
            return segment_pairs(rest, token, terms, term, 0)
        heads = [tuple(r) for r in rest.groupBy(head.alias("head")).agg(F.min(F.length(token)), F.max(F.length(token))).collect()]  # at most LONGEST + 1
        near = _least_by_pattern(rest, token, terms, term, head, heads, (shortest, longest), e)
        least = min((h for h, *_ in heads), default=longest)
        if longest - least <= PATTERN_LENGTH:
            return near
        more = segment_pairs(rest.where(head + PATTERN_LENGTH < longest), token, terms.where(F.length(term) > least + PATTERN_LENGTH), term, e)
        return near.unionByName(more)

    return _staged(tokens, token, lexicon, limit, found, "distance", term, lambda best, e: F.lit(True))


def strange_letters(text: Column, letters: list[str] | None) -> Column:
    """How many characters of a text are none of ``letters``; 0 for all texts without such a list."""
    if not letters:
        return F.lit(0)
    low = F.lower(text)
    return F.length(F.translate(low, "".join(letters), ""))


def alphabet(terms: DataFrame, term: str) -> list[str] | None:
    """The different lower-case characters of all terms, or none if they are more than ``MOST_LETTERS``."""
    found = terms.select(F.explode(F.array_distinct(F.split(F.lower(F.col(term)), ""))).alias("c")).where("c <> ''").distinct().limit(MOST_LETTERS + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= MOST_LETTERS else None


def nearest_by_weight(tokens: DataFrame, token: str, lexicon: DataFrame, term: str, fold: Callable[[Column], Column], weigh: Callable[[Column, Column], Column], limit: float, least: float = 0.0) -> DataFrame:
    """token, term and distance of the nearest term by a weighted distance of at most ``limit``; ties to the lesser term.

    ``fold`` maps to forms whose edit distance never exceeds the weighted one. So what is found among pairs of at most e
    folded edits is final if it is nearer than e + 1. ``least`` is what any edit costs at least, those that the fold forgives
    included: with f folded edits, and s characters that no term has, a pair costs at least (1 - least) f + least s. So
    tokens of many strange characters are final sooner, and leave once that is beyond the limit.
    """
    least = min(max(least, 0.0), 1.0)
    folded = lambda t, c, k: t.select(c, fold(F.col(c)).alias(k)).where(F.col(c).isNotNull()).distinct()
    words, terms = folded(tokens, token, "__a"), folded(lexicon, term, "__b")
    strange = strange_letters(F.col(token), alphabet(terms, term) if least else None)
    bound = lambda e: (1 - least) * e + least * strange - 1e-9

    def found(rest: DataFrame, e: int) -> DataFrame:
        near = rest.where(bound(e) <= limit).join(words, token) if e else rest.join(words, token)
        pairs = segment_pairs(near, "__a", terms, "__b", e).drop("distance")
        return spread(near.join(pairs, "__a").join(terms, "__b"), token).select(token, term, weigh(F.col(token), F.col(term)).alias("distance")).where(F.col("distance") <= limit)

    return _staged(tokens, token, lexicon, int(limit), found, "distance", term, lambda best, e: best < F.greatest(F.lit(float(e + 1)), bound(e + 1)))


def _staged(tokens: DataFrame, token: str, lexicon: DataFrame, limit: int, found: Callable[[DataFrame, int], DataFrame], distance: str, term: str, final: Callable[[Column, int], Column]) -> DataFrame:
    rest = tokens.select(token).where(F.col(token).isNotNull()).distinct()
    out = None
    for e in range(limit + 1):
        nearest = F.min(F.struct(F.col(distance).alias("d"), F.col(term).alias("t"))).alias("b")
        best = cut_lineage(found(rest, e).groupBy(token).agg(nearest).select(token, F.col("b.t").alias(term), F.col("b.d").alias(distance)))
        done = best.where(final(F.col(distance), e)) if e < limit else best
        out = done if out is None else out.unionByName(done)
        if e < limit:
            rest = cut_lineage(rest.join(done.select(token), token, "left_anti"))
            if rest.isEmpty():
                break
    return out
