"""Lexicon correction: look-alike repair, phrases, exact before fuzzy, candidate scores and suggestions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.functions.scalar import preserve_case
from clinspark.operators import fuzzy

#: Own small tables: text as read, text as meant.
CONFUSIONS = {"arnodarone": "amiodarone", "dally": "daily", "metforrnin": "metformin", "asprin": "aspirin", "diabetis": "diabetes"}
PHRASES = {"c/o sob": "complains of shortness of breath", "k/c/o": "known case of"}


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value for a lower-case key, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(c))


def degarble(word: Column, known: Column) -> Column:
    """A repaired spelling that is known: rn for m, 1 for l, or both; null if none is."""
    tries = [F.replace(word, F.lit("rn"), F.lit("m")), F.replace(word, F.lit("1"), F.lit("l")), F.replace(F.replace(word, F.lit("1"), F.lit("l")), F.lit("rn"), F.lit("m"))]
    return F.coalesce(*[F.when(F.array_contains(known, t), t) for t in tries])


def correct_text(text: Column, table: Mapping[str, str] = CONFUSIONS, phrases: Mapping[str, str] = PHRASES) -> Column:
    """Phrases first (the first place of each), then word by word, the case kept; separators stay as they are."""
    for a, b in phrases.items():
        at = F.instr(F.lower(text), a)
        text = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(b), F.substring(text, at + len(a), F.length(text)))).otherwise(text)
    words = F.split(text, "(?<=[^A-Za-z0-9])|(?=[^A-Za-z0-9])")
    return F.array_join(F.transform(words, lambda w: F.coalesce(preserve_case(w, lookup(w, table)), w)), "")


def candidate_score(distance: Column, term: Column, seen: Column, boost: Column) -> Column:
    """1 less the boosted distance over the length, times the ratio of lengths; never below 0."""
    longest = F.greatest(F.length(term), F.lit(3))
    ratio = F.least(F.length(term), F.length(seen)) / F.greatest(F.length(term), F.length(seen))
    return F.greatest(F.lit(0.0), 1 - (distance - boost) / longest) * ratio


def top_candidates(tokens: DataFrame, key: Sequence[str], token: str, lexicon: DataFrame, term: str, boost: str, limit: int = 2, k: int = 5) -> DataFrame:
    """The k best terms within ``limit`` edits; tokens that are terms have themselves alone, the rest join by deletion neighbourhoods."""
    exact = tokens.join(lexicon, F.col(token) == F.col(term)).withColumn("distance", F.lit(0))
    rest = tokens.join(lexicon.select(F.col(term).alias("__x")), F.col(token) == F.col("__x"), "left_anti")
    near = fuzzy.near_pairs(rest, token, lexicon, term, limit)
    found = rest.join(near, token).join(lexicon, term)
    both = exact.unionByName(found).withColumn("score", candidate_score(F.col("distance"), F.col(term), F.col(token), F.col(boost)))
    w = Window.partitionBy(*key).orderBy(F.desc("score"), term)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Pairs that inference by contained words takes.
MOST_PAIRS = 5_000


def infer_by_contains(table: DataFrame, key: str, text: str, pairs: DataFrame, needle: str, outcome: str) -> DataFrame:
    """key and the sorted set of outcomes whose needle the text holds, for keys with any; more than ``MOST_PAIRS`` pairs are refused."""
    known = pairs.select(F.lower(F.col(needle)).alias("n"), F.col(outcome).alias("o")).where("n IS NOT NULL").distinct().limit(MOST_PAIRS + 1).collect()
    if len(known) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs")
    rules = F.array(*[F.struct(F.lit(r["n"]).alias("n"), F.lit(r["o"]).alias("o")) for r in known]) if known else F.array().cast("array<struct<n:string,o:string>>")
    low = F.lower(F.col(text))
    hits = F.transform(F.filter(rules, lambda r: F.contains(low, r["n"])), lambda r: r["o"])
    return table.select(key, F.explode(hits).alias("__o")).groupBy(key).agg(F.array_sort(F.collect_set("__o")).alias("outcomes"))


def coverage(found: Column, wanted: Column, share: float = 0.8) -> Column:
    """Whether enough of the wanted values have a near match among the found ones."""
    hits = F.size(F.filter(wanted, lambda m: F.exists(found, lambda p: F.levenshtein(F.lower(m), F.lower(p)) <= 1)))
    return F.when(F.size(wanted) == 0, F.size(found) == 0).otherwise(hits / F.size(wanted) >= share)


def suggestions(table: DataFrame, columns: Sequence[str], text: str, key: str, taken: Sequence[str] = (), limit: int = 8) -> DataFrame:
    """The first few rows, in order of the key, that hold the text and aren't taken yet."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return table.where(hit & ~F.col(key).isin(list(taken))).orderBy(key).limit(limit)
