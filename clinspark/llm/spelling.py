"""Spelling variants: words one edit apart, found by an automaton over the halves of all words.

A word is cut into two segments, its first half and the rest. One inserted, deleted or replaced code point leaves one of the
two as it is: the first at the start of the other word, the second at its end. Shards hold the segments of their words in an
Aho-Corasick automaton; words are scanned, a segment found counts only at its offset and for words of a length that fits,
and the distance is verified.

A segment's shard is named by its outer three letters (its word's first or last) and the length of its word, so a word is
scanned by four shards, whatever the number of all: first or last letters, words of its own length and of one more. Every
pair meets once: the shorter word looks for the longer, of two of one length the lesser for the greater, and ends are left
out where the starts agree. A shard beyond ``PART`` segments is dealt into parts and its words into blocks, each pair of
both a task's work.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.common import ship_package, written

LETTERS = 6
OCCURRENCES = 5
#: A form is at least this many times as frequent as its variant.
FACTOR = 5
#: One in so many runs of letters loses a code point before it is counted (a planted slip; 0: none).
SLIP = 199
SHARD_ROWS, MAX_SHARDS = 20_000, 4096
PART, BLOCK = 50_000, 200_000
#: Words that share a segment are told apart one by one up to this many, beyond by what is left once a code point is out.
FEW = 32
#: A task's counts are handed on at so many different words; texts beyond LONG characters are read run by run.
HELD, LONG = 200_000, 1 << 20
OUTER = LETTERS // 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tally(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, slip: int = SLIP) -> DataFrame:
    """word and n: how often each run of at least so many letters occurs in all whole texts, A-Z lower-cased.

    Null texts have no words; a null key reads as empty.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[a-zÀ-ÿ]{%d,}" % letters)
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return made

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for name, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not whole:
                        continue
                    low = whole.encode().translate(_LOWER).decode()
                    start = zlib.crc32(f"{'' if name is None else name}:".encode())
                    for word, n in Counter(runs.findall(low) if len(low) <= LONG else (m.group() for m in runs.finditer(low))).items():
                        if slip and (h := zlib.crc32(word.encode(), start)) % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < letters:
                                continue
                        counts[word] = counts.get(word, 0) + n
                    if len(counts) > HELD:
                        yield out()
        yield out()

    named = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_edit(a: str, b: str) -> bool:
    """Whether ``b``, of the length of ``a`` or one more, differs by exactly one replaced or inserted code point."""
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] and i < n if n == len(b) else a[i:] == b[i + 1 :]


class Segment:
    """The words of a shard that share a segment, by their length."""

    def __init__(self) -> None:
        self.words: dict[int, list[str]] = {}
        self.index: dict[int, dict] = {}

    def near(self, word: str, length: int) -> Iterator[str]:
        """The words of that length (the word's, or one more) that are one edit away."""
        held = self.words.get(length, ())
        if len(held) <= FEW:
            yield from (w for w in held if one_edit(word, w))
            return
        index = self.index.get(length)
        if index is None:  # by what is left without each code point: no pair of the segment's words is tried in vain
            index = self.index[length] = {}
            for w in held:
                for k in range(length):
                    index.setdefault(w[:k] + w[k + 1 :], {}).setdefault(w, []).append(k)
        if length > len(word):
            yield from index.get(word, ())
        else:
            for k in range(length):
                yield from (w for w, at in index.get(word[:k] + word[k + 1 :], {}).items() if k in at and w != word)


class Halves:
    """Automata over the first and the second segments of words."""

    def __init__(self) -> None:
        import ahocorasick

        self.held: tuple[dict[str, Segment], dict[str, Segment]] = ({}, {})
        self.automata = (ahocorasick.Automaton(), ahocorasick.Automaton())
        self.ready = False

    def add(self, side: int, word: str) -> None:
        half = len(word) // 2
        self.held[side].setdefault(word[half:] if side else word[:half], Segment()).words.setdefault(len(word), []).append(word)

    def near(self, side: int, word: str, length: int) -> Iterator[str]:
        """Held words of that length, one edit away, that share the side's segment with ``word``; each pair from one side alone."""
        if not self.ready:
            for automaton, held in zip(self.automata, self.held, strict=True):
                for text, segment in held.items():
                    automaton.add_word(text, (len(text), segment))
                automaton.make_automaton()
            self.ready = True
        if not self.held[side]:
            return
        half = length // 2
        wide = length - half if side else half  # of the segments of words of that length
        for end, (size, segment) in self.automata[side].iter(word):
            if size != wide or (end != len(word) - 1 if side else end != size - 1):
                continue  # not at its offset, or of words of another length
            for other in segment.near(word, length):
                if (length > len(word) or word < other) and not (side and word[:half] == other[:half]):
                    yield other


def near_words(spark: SparkSession, words: DataFrame, part: int = PART, block: int = BLOCK) -> DataFrame:
    """word, other, other_n: each two of the different ``words`` (word, n; at least six code points) that are one edit apart, both ways."""
    ship_package(spark)
    shards = min(MAX_SHARDS, max(8, -(-2 * words.count() // SHARD_ROWS)))
    outer = [F.substring("word", 1, OUTER), F.expr(f"right(word, {OUTER})")]

    def rows(kind: int, lengths: list[int]) -> DataFrame:
        places = [F.struct(F.pmod(F.xxhash64(F.lit(s), outer[s], F.length("word") + more), F.lit(shards)).cast("int").alias("shard"), F.lit(s).alias("side"), (F.length("word") + more).alias("length")) for s in (0, 1) for more in lengths]
        return words.select("word", "n", F.explode(F.array(*places)).alias("at")).select("at.*", F.lit(kind).alias("kind"), "word", "n")

    both = rows(0, [0]).union(rows(1, [0, 1]))
    sizes = both.groupBy("shard").agg(F.ceil(F.count_if(F.col("kind") == 0) / part).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("kind") == 1) / block)).cast("int").alias("blocks"))
    sizes, _ = written(spark, sizes, "shard-sizes")  # at most MAX_SHARDS rows
    sized = both.join(F.broadcast(sizes), "shard").where("parts > 0")
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    held = F.col("kind") == 0
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = sized.withColumn("part", F.explode(F.when(held, F.array(deal("parts"))).otherwise(every("parts"))))
    dealt = dealt.withColumn("block", F.explode(F.when(held, every("blocks")).otherwise(F.array(deal("blocks")))))
    keys = ["shard", "part", "block"]
    dealt = dealt.select(*keys, "kind", "side", "length", "word", "n").repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, halves, counts = None, Halves(), {}
        for batch in batches:
            found: list[tuple[str, str, int]] = []
            for shard, p, b, kind, side, length, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, p, b) != key:
                    key, halves, counts = (shard, p, b), Halves(), {}
                if kind == 0:
                    halves.add(side, word)
                    counts[word] = n
                else:
                    for other in halves.near(side, word, length):
                        found += ((word, other, counts[other]), (other, word, n))
                    if len(found) > 50_000:
                        yield out(found)
                        found = []
            yield out(found)

    def out(found: list[tuple[str, str, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "other", "other_n"])

    return dealt.mapInArrow(run, "word string, other string, other_n long")


def roots(spark: SparkSession, links: DataFrame) -> DataFrame:
    """word and root of every row of ``links`` (word, form): forms followed to the last. Forms must not lead in a circle.

    Each round doubles the steps that are taken; a form is FACTOR times as frequent, so there are few rounds.
    """
    current, _ = written(spark, links.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if current.join(on, "root", "left_semi").isEmpty():
            return current
        current, _ = written(spark, current.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")


def variants(spark: SparkSession, counted: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n and root of the different words of ``counted`` (word, n).

    The form is the near word of the largest n (ties: the smallest in code-point order), if n is ``factor`` times the
    word's or more; else null, and the word is its own root. Null words and words of under six code points are left out,
    other columns dropped; an empty table stays one.
    """
    words, _ = written(spark, counted.select("word", "n").where(F.length("word") >= LETTERS), "words")
    near = near_words(spark, words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = words.join(near, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    formed, _ = written(spark, best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "formed")
    root = roots(spark, formed.where("form IS NOT NULL"))
    return formed.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least six code points that occurs at least five times."""
    return variants(spark, tally(docs).where(F.col("n") >= OCCURRENCES)).select("word", "form", "root", "n", "n_near", "form_n")
