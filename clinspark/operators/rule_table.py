"""Inference rules as a table: regular expressions with their groups, tried only on texts that hold one of a rule's words.

A rule may name anchors: words one of which every text that it matches holds. Texts meet rules by their words in a hash join,
so a rule that can't match costs nothing, however many there are. What meets goes through a table function that gives a row
for each match, with its groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of one text that a call of the table function takes.
AT_ONCE = 200


@F.udtf(returnType="rule string, found string, start int, groups array<string>")
class RuleMatches:
    """Table function: the first match of each rule (struct<rule, pattern>) in a text, its place and its groups (null: took no part)."""

    def __init__(self) -> None:
        self.compiled: dict[str, re.Pattern] = {}

    def eval(self, text: str, rules: list) -> Iterator[tuple]:
        for rule in rules or []:
            pattern = self.compiled.get(rule["pattern"])
            if pattern is None:
                if len(self.compiled) > 10_000:
                    self.compiled.clear()
                pattern = self.compiled[rule["pattern"]] = re.compile(rule["pattern"])
            m = pattern.search(text) if text is not None else None
            if m:
                yield rule["rule"], m.group(0), m.start(), list(m.groups())


def words_of(text: str) -> F.Column:
    """Different runs of letters and runs of digits of a text, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("\\p{L}+|\\p{Nd}+"), F.lit(0)))


def matches(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """key, rule, infers, found, start and groups: the first match of every rule in every row of ``texts``.

    rules: rule, pattern (Python's syntax), infers, anchors (array of words, or null for a rule that is tried on every text).
    Anchors are compared with runs of letters or digits, case ignored. Null texts match nothing; rows that repeat come out
    once each; rules of one name are one rule (the least pattern).
    """
    once = rules.groupBy("rule").agg(F.min(F.struct("pattern", "infers", "anchors")).alias("r")).select("rule", "r.*")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.sha2(F.concat_ws("\x01", F.col(key).cast("string"), F.col(text)), 256).alias("row")).dropDuplicates(["row"])
    repeats = texts.where(F.col(text).isNotNull()).groupBy(F.sha2(F.concat_ws("\x01", F.col(key).cast("string"), F.col(text)), 256).alias("row")).agg(F.count("*").alias("times"))
    anchored = once.where(F.col("anchors").isNotNull()).select(F.explode(F.array_distinct(F.transform("anchors", lambda a: F.lower(a)))).alias("word"), "rule", "pattern")
    met = rows.select("row", F.explode(words_of("text")).alias("word")).join(anchored, "word").select("row", "rule", "pattern").distinct()
    chunk = F.pmod(F.xxhash64("rule"), F.ceil(F.count("*").over(_by("row")) / AT_ONCE)).cast("int")
    called = met.withColumn("chunk", chunk).groupBy("row", "chunk").agg(F.collect_list(F.struct("rule", "pattern")).alias("rules")).join(rows, "row").select("row", "key", "text", "rules")
    free = once.where(F.col("anchors").isNull()).select("rule", "pattern")
    every = [tuple(r) for r in free.limit(AT_ONCE * 50 + 1).collect()]
    if len(every) > AT_ONCE * 50:
        raise ValueError("too many rules without anchors: give them some")
    if every:
        # The few rules without anchors travel with the plan, and are tried on every text.
        listed = F.array(*[F.struct(F.lit(a).alias("rule"), F.lit(b).alias("pattern")) for a, b in every])
        called = called.unionByName(rows.select("row", "key", "text", listed.alias("rules")))
    found = called.lateralJoin(RuleMatches(F.col("text").outer(), F.col("rules").outer())).select("row", "key", "rule", "found", "start", "groups")
    out = found.join(repeats, "row").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.join(once.select("rule", "infers"), "rule").select(F.col("key").alias(key), "rule", "infers", "found", "start", "groups")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)
