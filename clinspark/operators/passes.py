"""Correction of texts in passes over lexicon tables of any size, with a list of what was changed and flags of odd values.

1. Confusables: parts of words, case kept, all found at once by a multi-pattern automaton that runs over the different words.
2. Phrases: runs of words, found by a hash of all their words and then compared in place.
3. Words: entries of a dictionary; else spellings repaired by swaps of characters, which must be known.
4. Flags: laboratory values far beyond their limits. They change nothing.

Words repeat, so what is wrong with a word is decided once, for the vocabulary; only the places of wrong words travel to their
texts. Texts without any stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.operators.clinical_text import LAB_PATTERNS, LABS, far_beyond
from clinspark.sources.store import cut_lineage

#: Characters trimmed from both ends of a word.
PUNCTUATION = ".,;:!?()[]{}\"'"
_BLANK = r" \t\n\r\f\x0B"
_TOKENS = f"[{_BLANK}]+|[^{_BLANK}]+"
#: Swaps of one kind that are tried on words that the dictionary doesn't hold, in this order.
SWAPS = (("0", "o"), ("1", "i"), ("l", "i"), ("i", "l"), ("vv", "w"), ("cl", "d"), ("5", "s"), ("8", "b"))
#: Bytes of patterns that one automaton holds; more are dealt to several.
MOST_BYTES = 16 << 20
#: Bytes of fixes that a broadcast may hold; beyond, the words are shuffled to them.
BROADCAST_BYTES = 32 << 20
CHANGE = "array<struct<pass:int,place:int,original:string,corrected:string,method:string>>"


def words(text: Column) -> Column:
    """The words of a text with what punctuation they have, and an empty one at the end where white space trails."""
    return F.split(F.ltrim(text, F.lit(" \t\n\r\f\v")), f"[{_BLANK}]+")


def core(token: Column) -> Column:
    return F.btrim(token, F.lit(PUNCTUATION))


def words_of(rows: DataFrame) -> DataFrame:
    """row, place and core of every word of ``rows`` (row, text)."""
    found = rows.select("row", F.posexplode_outer(words(F.col("text"))).alias("place", "token"))  # an inner one would split texts once more, to see which have words
    return found.select("row", "place", core(F.col("token")).alias("core")).where("core <> ''")


def cased(model: Column, word: Column) -> Column:
    """All upper as the model, or its first letter upper, else all lower."""
    first = F.substring(model, 1, 1)
    return F.when(model == F.upper(model), F.upper(word)).when(first == F.upper(first), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))).otherwise(F.lower(word))


def _first_meant(table: DataFrame) -> DataFrame:
    """One row for each seen; of several the least meant."""
    return table.where("seen IS NOT NULL AND seen <> '' AND meant IS NOT NULL").groupBy("seen").agg(F.min("meant").alias("meant"))


def part_hits(words: DataFrame, parts: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """core, start (from 0), size and meant of every part (seen, meant) inside every word of ``words`` (core)."""
    once = _first_meant(parts)
    n = once.agg(F.sum(F.octet_length("seen") + F.octet_length("meant"))).first()[0] or 0
    shards = max(1, math.ceil(n / most_bytes))
    found = []
    for shard in range(shards):  # one automaton at a time passes the driver, each of a bounded size
        held = [tuple(r) for r in once.where(F.pmod(F.xxhash64("seen"), F.lit(shards)) == shard).collect()]

        def scan(batches: Iterator[pa.RecordBatch], held: list[tuple[str, str]] = held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for seen, meant in held:
                automaton.add_word(seen, (len(seen), meant))
            automaton.make_automaton()
            for batch in batches:
                out = [(w, end - size + 1, size, meant) for w in batch.column(0).to_pylist() for end, (size, meant) in automaton.iter(w)] if held else []
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["core", "start", "size", "meant"])

        found.append(words.select("core").mapInArrow(scan, "core string, start int, size int, meant string"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def confusable_fixes(words: DataFrame, confusables: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """core and meant of the words that hold confusables (seen, meant, whole): from left to right, the longest first, none overlapping.

    Whole ones are whole words alone, and go before parts.
    """
    whole = words.join(_first_meant(confusables.where("whole")).withColumnRenamed("seen", "core"), "core").select("core", "meant")
    hits = part_hits(words, confusables.where("NOT coalesce(whole, false)"), most_bytes)
    sorted_hits = F.array_sort(F.collect_list(F.struct("start", (-F.col("size")).alias("less"), "meant")))
    grouped = hits.groupBy("core").agg(sorted_hits.alias("hits"))
    start = F.struct(F.lit(0).alias("until"), F.lit("").alias("out"))
    take = lambda s, h: F.when(h["start"] >= s["until"], F.struct((h["start"] - h["less"]).alias("until"), F.concat(s["out"], F.substring("core", s["until"] + 1, h["start"] - s["until"]), h["meant"]).alias("out"))).otherwise(s)
    parts = grouped.select("core", F.aggregate("hits", start, take, lambda s: F.concat(s["out"], F.substring("core", s["until"] + 1, F.lit(1 << 30)))).alias("meant"))
    return whole.unionByName(parts.join(whole.select("core"), "core", "left_anti")).where("core <> meant")


def split_phrases(phrases: DataFrame) -> DataFrame:
    """key, n, words and meant of the different phrases (seen, meant), case ignored; of several for the same words the least meant."""
    split = _first_meant(phrases.select(F.lower(F.trim("seen")).alias("seen"), "meant")).select("meant", F.split("seen", f"[{_BLANK}]+").alias("words"))
    once = split.where(~F.array_contains("words", "")).groupBy("words").agg(F.min("meant").alias("meant"))
    return once.select(F.xxhash64(F.transform("words", lambda w: F.xxhash64(w))).alias("key"), F.size("words").alias("n"), "words", "meant")


def phrase_hits(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """row, place, n, words and meant of the phrases of :func:`split_phrases` in ``rows`` (row, text), by a hash of all their words.

    Each run of words as long as any phrase asks once, so the hits don't grow with the phrases that share a word. A hit
    whose hash alone agrees is sorted out where its text lies.
    """
    lengths = sorted(r[0] for r in phrases.select("n").distinct().collect())  # numbers of words of phrases
    if not lengths:
        return rows.select("row", F.lit(0).alias("place")).crossJoin(phrases.drop("key")).limit(0)
    hashed = rows.select("row", F.transform(words(F.col("text")), lambda t: F.xxhash64(F.lower(core(t)))).alias("h"))
    of = lambda n: F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(0), F.size("h") - n), lambda i: F.struct(i.alias("place"), F.lit(n).alias("n"), F.xxhash64(F.slice("h", i + 1, n)).alias("key"))))
    runs = hashed.select("row", F.inline(F.flatten(F.array_compact(F.array(*[of(n) for n in lengths])))))
    return runs.join(phrases, ["n", "key"]).select("row", "place", "n", "words", "meant")


def spellings(low: Column, swaps: Sequence[tuple[str, str]]) -> Column:
    """Repaired spellings in the order they are tried: array of struct<spelling, known>; known ones needn't be dictionary entries."""
    one = lambda s, known: F.struct(s.alias("spelling"), F.lit(known).alias("known"))
    rn, l1 = F.replace(low, F.lit("rn"), F.lit("m")), F.replace(low, F.lit("1"), F.lit("l"))
    tried = [one(low, False), *[one(F.replace(low, F.lit(a), F.lit(b)), False) for a, b in swaps], one(rn, True), one(l1, True), one(F.replace(rn, F.lit("1"), F.lit("l")), True)]
    places = F.when(F.length(low) > 3, F.filter(F.sequence(F.lit(2), F.length(low)), lambda i: F.substring(low, i, F.lit(1)) == "l")).otherwise(F.array().cast("array<int>"))
    inner = F.transform(places, lambda i: one(F.concat(F.substring(low, F.lit(1), i - 1), F.lit("i"), F.substring(low, i + 1, F.length(low))), True))
    return F.concat(F.array(*tried), inner)


def word_fixes(words: DataFrame, dictionary: DataFrame, known: DataFrame, swaps: Sequence[tuple[str, str]] = SWAPS, least: int = 3) -> DataFrame:
    """core, meant and method of the words (core) of at least so many characters that the dictionary (seen, meant) or a repaired spelling corrects.

    The first spelling that is an entry of the dictionary, or known (word) where that is enough, decides; the case is kept.
    """
    entries = _first_meant(dictionary.select(F.lower("seen").alias("seen"), "meant")).select(F.col("seen").alias("spelling"), F.col("meant").alias("entry"))
    fine = known.select(F.lower("word").alias("spelling")).where("spelling IS NOT NULL").distinct().withColumn("is_known", F.lit(True))
    low = words.where(F.length("core") >= least).select(F.lower("core").alias("low")).distinct()
    tried = low.select("low", F.posexplode(spellings(F.col("low"), swaps)).alias("rank", "s")).select("low", "rank", "s.*").where((F.col("rank") == 0) | (F.col("spelling") != F.col("low")))
    met = tried.join(entries, "spelling", "left").join(fine, "spelling", "left").where(F.col("entry").isNotNull() | (F.col("known") & F.col("is_known")))
    first = met.groupBy("low").agg(F.min(F.struct("rank", F.coalesce("entry", "spelling").alias("meant"))).alias("b")).select("low", F.col("b.meant").alias("meant"), F.when(F.col("b.rank") == 0, "dictionary").otherwise("char_swap").alias("method"))
    all_words = words.where(F.length("core") >= least).select("core", F.lower("core").alias("low"))
    return all_words.join(first, "low").where(F.lower("meant") != F.col("low")).select("core", cased(F.col("core"), F.col("meant")).alias("meant"), "method")


def rewrite(text: str, hits: list[dict], number: int) -> tuple[str, list[dict]]:
    """The text with its hits applied from left to right, the longest first, none overlapping; and what was changed where."""
    parts = re.findall(_TOKENS, text)
    at = [i for i, t in enumerate(parts) if t[0] not in " \t\n\r\f\v"]
    cores = {}
    changes, until = [], 0
    for h in sorted(hits, key=lambda h: (h["place"], -h["n"], h["meant"], h["method"])):
        place, n = h["place"], h["n"]
        if place < until or place + n > len(at):
            continue
        for k in range(place, place + n):
            cores.setdefault(k, parts[at[k]].strip(PUNCTUATION))
        if h["words"] is not None and [cores[k].lower() for k in range(place, place + n)] != h["words"]:
            continue
        i, j = at[place], at[place + n - 1]
        before = parts[i][: parts[i].index(cores[place])]
        after = parts[j][parts[j].rindex(cores[place + n - 1]) + len(cores[place + n - 1]) :]
        whole = "".join(parts[i : j + 1])
        original = whole[len(before) : len(whole) - len(after)]
        if original != h["meant"]:
            changes.append({"pass": number, "place": place, "original": original, "corrected": h["meant"], "method": h["method"]})
            parts[i : j + 1] = [before + h["meant"] + after] + [""] * (j - i)
        until = place + n
    return "".join(parts), changes


def _carried(fixes: DataFrame) -> DataFrame:
    """``fixes`` worked out once, and broadcast where they are small, so that only the places of wrong words are shuffled."""
    made = cut_lineage(fixes)
    size = made.agg(F.sum(sum((F.coalesce(F.octet_length(F.concat_ws(" ", c)), F.lit(0)) for c, t in made.dtypes if "string" in t), F.lit(32)))).first()[0] or 0
    return F.broadcast(made) if size <= BROADCAST_BYTES else made


def _apply(rows: DataFrame, hits: DataFrame, number: int) -> DataFrame:
    """``rows`` (row, sha, text, corrections) after the hits (row, place, n, words, meant, method) of a pass."""
    grouped = hits.groupBy("row").agg(F.collect_list(F.struct("place", "n", "words", "meant", "method")).alias("hits"))
    schema = f"row long, sha binary, text string, corrections {CHANGE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*(new := rewrite(text, own, number) if own else (text, []))[:1], [*before, *new[1]]) for text, before, own in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            change = pa.list_(pa.struct([("pass", pa.int32()), ("place", pa.int32()), ("original", pa.string()), ("corrected", pa.string()), ("method", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], change)], names=["row", "sha", "text", "corrections"])

    return rows.join(grouped, "row", "left").select("row", "sha", "text", "corrections", "hits").mapInArrow(run, schema)  # texts are shuffled once


def value_flags(text: Column) -> Column:
    """array<struct<name, value>>: laboratory values over five times the upper or below a tenth of the lower normal limit."""

    def of(name: str) -> Column:
        values = F.transform(F.regexp_extract_all(text, F.lit("(?i)" + LAB_PATTERNS[name]), F.lit(1)), lambda v: v.try_cast("double"))
        odd = F.filter(values, lambda v: far_beyond(v, LABS[name].low, LABS[name].high, 5.0, 0.1))
        return F.transform(odd, lambda v: F.struct(F.lit(name).alias("name"), v.alias("value")))

    return F.concat(*[of(name) for name in LAB_PATTERNS if name in LABS])


def correct(texts: DataFrame, text: str, confusables: DataFrame, phrases: DataFrame, dictionary: DataFrame, known: DataFrame, swaps: Sequence[tuple[str, str]] = SWAPS, least: int = 3) -> DataFrame:
    """``texts`` with corrected (the text after three passes), corrections (pass, place of the word, original, corrected, method) and flags.

    Tables: confusables (seen, meant, whole), phrases (seen, meant; case ignored), dictionary (seen, meant; case ignored),
    known (word). They may be empty and of any size; of several entries for one key the least counts. Null texts stay null with
    no corrections. Repeated rows come out alike. Columns of the names added are replaced.
    """
    kept = texts.select(*[F.col(f"`{c}`") for c in texts.columns if c.lower() not in ("corrected", "corrections", "flags", "__row")]).withColumn("__row", F.unhex(F.sha2(F.col(f"`{text}`"), 256)))
    none = F.array().cast(CHANGE)
    once = kept.select(F.col("__row").alias("sha"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").dropDuplicates(["sha"])
    rows = cut_lineage(once.select(F.monotonically_increasing_id().alias("row"), "sha", "text", none.alias("corrections")))  # places travel with a short number, fixed by the checkpoint
    single = lambda t: t.select("row", "place", F.lit(1).alias("n"), F.lit(None).cast("array<string>").alias("words"), "meant", "method")

    vocabulary = cut_lineage(words_of(rows).groupBy("core").agg(F.count("*").alias("n")))
    fixes = _carried(confusable_fixes(vocabulary, confusables).withColumn("method", F.lit("confusable")))
    rows = cut_lineage(_apply(rows, single(words_of(rows).join(fixes, "core")), 1))

    met = phrase_hits(rows, _carried(split_phrases(phrases))).withColumn("method", F.lit("phrase"))
    rows = cut_lineage(_apply(rows, met, 2))

    vocabulary = cut_lineage(words_of(rows).groupBy("core").agg(F.count("*").alias("n")))
    fixes = _carried(word_fixes(vocabulary, dictionary, known, swaps, least))
    done = _apply(rows, single(words_of(rows).join(fixes, "core")), 3).select(F.col("sha").alias("__row"), F.col("text").alias("corrected"), "corrections")
    return kept.join(done, "__row", "left").select(*[F.col(f"`{c}`") for c in kept.columns if c != "__row"], "corrected", F.coalesce("corrections", none).alias("corrections"), F.coalesce(value_flags(F.col("corrected")), F.array().cast("array<struct<name:string,value:double>>")).alias("flags"))
