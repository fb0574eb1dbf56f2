"""Concepts: terms that a table of synonyms connects, colloquial terms, and lookups that look past qualifiers.

Synonyms are pairs of any origin; a concept is a connected component of them, named by its least term. Phrases of a table are
looked up by joins, so neither side has a bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.operators.records import merge_groups
from clinspark.sources.store import cut_lineage

#: Words that qualify a condition without changing what it is.
QUALIFIERS = ("acute", "chronic", "severe", "mild", "moderate", "bilateral", "left", "right", "upper", "lower")


def term_key(c: Column) -> Column:
    """Lower case, white space folded; blank is null."""
    low = F.trim(F.regexp_replace(F.lower(c), "[ \\t\\r\\n]+", " "))
    return F.when(low != "", low)


def without_qualifiers(key: Column, qualifiers: Sequence[str], ends: str = "both") -> Column:
    """The forms of a key that are looked up, in order: as it is, then without the qualifier at its start, and so on.

    ``ends`` "first" takes one word from the start alone; "both" every qualifier from the start, then also from the end.
    """
    one = "(?:" + "|".join(qualifiers) + ")"
    if not qualifiers:
        return F.array(key)
    first = F.regexp_replace(key, f"^{one} +", "")
    if ends == "first":
        return F.array_distinct(F.array(key, first))
    every = F.regexp_replace(key, f"^(?:{one} +)+", "")
    return F.array_distinct(F.array(key, first, every, F.regexp_replace(every, f"(?: +{one})+$", "")))


def concepts(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """term and concept (the least term that is connected) of every term of the pairs; a pair with a null makes a concept of its own."""
    x, y = term_key(F.col(a)), term_key(F.col(b))
    keyed = cut_lineage(pairs.select(x.alias("src"), y.alias("dst")))
    nodes = keyed.select(F.explode(F.array("src", "dst")).alias("term")).where("term IS NOT NULL").distinct()
    edges = keyed.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    return merge_groups(nodes, "term", edges).select("term", F.col("group").alias("concept"))


def resolve(table: DataFrame, text: str, known: DataFrame, colloquial: DataFrame | None = None, qualifiers: Sequence[str] = QUALIFIERS, ends: str = "both") -> DataFrame:
    """``table`` with term and concept of its text: the first of its forms that is known; null where none is.

    ``colloquial`` (said, meant) goes before: a text that is said is looked up as what is meant, the least if there are
    several. A known term may have one concept alone. Columns of the names added are replaced.
    """
    kept = table.select(*[F.col(f"`{c}`") for c in table.columns if c.lower() not in ("term", "concept", "__key")]).withColumn("__key", term_key(F.col(f"`{text}`")))
    asked = kept.select(F.col("__key").alias("said")).where("said IS NOT NULL").distinct()
    if colloquial is not None:
        said = colloquial.select(term_key(F.col("said")).alias("said"), term_key(F.col("meant")).alias("meant")).where("said IS NOT NULL AND meant IS NOT NULL").groupBy("said").agg(F.min("meant").alias("meant"))
        asked = asked.join(said, "said", "left").select("said", F.coalesce("meant", "said").alias("looked"))
    else:
        asked = asked.select("said", F.col("said").alias("looked"))
    forms = asked.select("said", F.posexplode(without_qualifiers(F.col("looked"), qualifiers, ends)).alias("rank", "term"))
    first = forms.join(known.select("term", "concept"), "term").groupBy("said").agg(F.min(F.struct("rank", "term", "concept")).alias("f"))
    out = kept.join(first.select(F.col("said").alias("__key"), "f.term", "f.concept"), "__key", "left")
    return out.select(*[F.col(f"`{c}`") for c in kept.columns if c != "__key"], "term", "concept")


def synonyms(pairs: DataFrame, a: str, b: str, known: DataFrame, qualifiers: Sequence[str] = QUALIFIERS) -> DataFrame:
    """``pairs`` with alike: whether both texts are of one concept; false where either is unknown."""
    left = resolve(pairs, a, known, None, qualifiers).withColumnsRenamed({"concept": "__a"}).drop("term")
    both = resolve(left, b, known, None, qualifiers).drop("term")
    return both.withColumn("alike", F.coalesce(F.col("__a") == F.col("concept"), F.lit(False))).drop("__a", "concept")
