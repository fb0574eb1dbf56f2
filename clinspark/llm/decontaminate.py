"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows meet in a hash join.

A text is read twice: as plain words (letters and digits, in lower case), and as slots, in which a number with its
decimals or groups is one <number>, a listed unit a <unit>, and a run of words with a capital and a small letter inside a
sentence one <name>; all else is literal. Every run of ``width`` slots, and of ``width`` plain words, is a window. A
document window that equals an item's window of the same form, word by word, is a match: plain words find a copy in any
case or wrapping and windows of hardly any literals, templates find other numbers and names. A template match carries
the words that fill the slots on both sides. Template matches count only while slots are consistent: one word of the item
always stands for the same word of the document. So a question with other numbers or names is still caught, and a
template that merely looks alike, filled at random, is not.

Matches whose offsets (document word less item word) lie within a small band belong together, so an inserted, dropped or
changed word costs the words of the item that no window covers any more, not the windows beside them. A document leaks an
item if such matches cover ``share`` of the item's words or windows, or at least ``enough`` windows of a longer item.

All of it is DataFrame operations. Before windows are built, each position of a document is held against the hashes of
the first ``anchor`` words of all item windows: a set in the plan while the benchmark is small, a broadcast table of them
up to a checked number of rows. Beyond that every window's hash is shuffled to the benchmark's, with the document's key
and the place alone; the words are fetched for the documents that have a match. No way drops a match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.common import few_files, written

WIDTH = 8
ANCHOR = 3
SHARE = 0.65
ENOUGH = 18
#: Offsets that differ by up to half of this belong together.
BAND = 16
#: Literal words that a template window needs, so that a row of placeholders alone matches nothing; plain words need none.
LITERALS = 4
#: Item windows up to which their anchors are put into the plan as a set.
ANCHORS = 50_000
#: Different anchors up to which a table of them is broadcast (about 50 bytes each).
BROADCAST_ANCHORS = 2_000_000
#: Words for units.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl dl l liter liters litre litres gallon gallons "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules"
).split()
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Put before a word that has a capital inside a sentence, and between the words of one slot.
_MARK, _JOIN, _FIRST = "\x01", "\x02", "\x03"
#: Forms of a window.
TEMPLATE, PLAIN = 0, 1


def slots_of(text: Column) -> Column:
    """Slots of a text, one blank between two: letters and digits, in lower case, with marks and joints."""
    marked = F.regexp_replace(text, "(?=\\p{Lu}\\p{Ll})(?<=[^\\s.!?:;\"'(\\[\\u0001][\"',)\\]]?[ \\t])", _MARK)
    named = F.regexp_replace(marked, "(\\u0001[\\p{L}\\p{N}]+)[ \\t]+(?=\\u0001)", "$1" + _JOIN)
    numbered = F.regexp_replace(named, "[.,](?<=\\p{Nd}.)(?=\\p{Nd})", _JOIN)
    return F.btrim(F.regexp_replace(F.lower(numbered), "[^\\p{L}\\p{N}\\u0001\\u0002]+", " "))


def plain_of(slots: Column) -> Column:
    """The same without marks and joints: plain words."""
    return F.translate(slots, _JOIN + _MARK, " ")


def template_of(words: Column) -> Column:
    def one(w: Column) -> Column:
        return (
            F.when(F.startswith(w, F.lit(_MARK)), F.lit(NAME))
            .when((w >= "0") & (w < ":"), F.lit(NUMBER))
            .when(w.isin(UNITS), F.lit(UNIT))
            .otherwise(w)
        )

    return F.transform(words, one)


def _read(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, joined slots (s), slots, words and template of every row; a text without words has one empty word."""
    joined = rows.select(F.col(key).alias("key"), slots_of(F.col(text)).alias("s"))
    parts = joined.select("key", "s", F.split("s", " ").alias("slots"), F.split(plain_of(F.col("s")), " ").alias("words"))
    return parts.select("key", "s", "slots", "words", template_of(F.col("slots")).alias("template"))


def places_of(joined: Column) -> Column:
    """The place of each slot among the plain words, for all slots at once."""
    words = F.split(F.translate(F.replace(joined, F.lit(" "), F.lit(" " + _FIRST)), _JOIN, " "), " ")
    return F.filter(F.transform(words, lambda w, i: F.when((i == 0) | F.startswith(w, F.lit(_FIRST)), i)), lambda i: i.isNotNull())


def item_windows(items: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """item, m (plain words), n (plain windows), form, at (plain word), len (plain words), width, hash, anchor, window, item_words and pos of every window.

    An item of fewer than ``width`` words is one window. One of up to twice ``width`` has windows of under half its words
    (over half of ``width`` at least), so that one changed word leaves some.
    """
    t = _read(items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).dropDuplicates([key, text]), key, text).where(F.element_at("words", 1) != "")
    m, least = F.size("words"), width // 2 + 1
    wide = F.when(m < width, m).when(m <= 2 * width, F.greatest(F.lit(min(least, width)), F.floor((m - 1) / 2).cast("int"))).otherwise(width)
    t = t.select(F.col("key").alias("item"), "slots", "words", "template", places_of(F.col("s")).alias("pos"), m.alias("m"), wide.alias("wide")).withColumn("n", F.col("m") - F.col("wide") + 1)
    short = t.withColumn("width", F.least("wide", F.size("slots")))

    def windows(rows: DataFrame, form: int, last: Column, one: Callable[[Column], list[Column]]) -> DataFrame:
        """A row for each window; it carries its own slices alone, however long the item."""
        every = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(*one(i)))
        return rows.select("item", "m", "n", F.lit(form).alias("form"), "width", F.explode(every).alias("w")).select("item", "m", "n", "form", "w.at", "w.len", "width", "w.window", "w.item_words", "w.pos")

    cut = lambda c, i: F.slice(c, i + 1, F.col("width"))
    start = lambda i: F.get("pos", i)
    length = lambda i: F.coalesce(F.get("pos", i + F.col("width")), F.col("m")) - start(i)
    shaped = windows(short, TEMPLATE, F.size("slots") - F.col("width"), lambda i: [start(i).alias("at"), length(i).alias("len"), cut("template", i).alias("window"), cut("slots", i).alias("item_words"), cut("pos", i).alias("pos")])
    literal = F.size(F.filter("window", lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    shaped = shaped.where(literal >= F.least(F.lit(LITERALS), F.col("width")))
    none = F.array().cast("array<int>")
    plain = windows(t.withColumn("width", F.col("wide")), PLAIN, F.col("n") - 1, lambda i: [i.alias("at"), F.col("width").alias("len"), cut("words", i).alias("window"), cut("words", i).alias("item_words"), none.alias("pos")])
    return shaped.unionByName(plain).withColumns({"hash": F.xxhash64("form", "window"), "anchor": F.xxhash64(F.slice("window", 1, ANCHOR))})


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, width: int) -> DataFrame:
    """key, of, item, m, n, doc_at, at, len and the filled slots of every window match; places are plain words."""
    windows, _ = written(spark, item_windows(items, item_key, item_text, width), "item-windows")
    few = windows.count() <= ANCHORS
    t = _read(docs.where(F.col(text).isNotNull()), key, text)
    sorts = windows.select("form", "width").distinct().collect()  # a row for each form and width
    anchors: dict[tuple[int, int], list[int]] = {}
    if few:
        for r in windows.select("form", F.least("width", F.lit(ANCHOR)).alias("first"), "anchor").distinct().collect():  # at most ANCHORS hashes
            anchors.setdefault((r["form"], r["first"]), []).append(r["anchor"])
    kinds = sorted({(r["form"], min(r["width"], ANCHOR)) for r in sorts})

    def read(form: int) -> Column:
        return F.col("template" if form == TEMPLATE else "words")

    def anchor_at(form: int, first: int, i: Column) -> Column:
        return F.xxhash64(*[F.get(read(form), i + k) for k in range(first)])

    def widths_of(form: int, first: int) -> list[int]:
        return sorted(r["width"] for r in sorts if (r["form"], min(r["width"], ANCHOR)) == (form, first))

    def place(form: int, i: Column, w: Column) -> Column:
        return F.struct(F.lit(form).alias("form"), i.alias("at"), w.alias("width"))

    def places(form: int, first: int) -> Column:
        """form, at and width of the windows of this form that may be an item's: ``first`` words of each are looked up."""
        widths = F.array(*map(F.lit, widths_of(form, first)))
        found = F.filter(F.sequence(F.lit(0), F.size(read(form)) - 1), lambda i: anchor_at(form, first, i).isin(anchors[form, first]))
        return F.flatten(F.transform(found, lambda i: F.transform(widths, lambda w: place(form, i, w))))

    def hashed_places(form: int, first: int) -> Column:
        """All windows of this form, with the hashes of their first words and of the whole."""
        widths = F.array(*map(F.lit, widths_of(form, first)))

        def one(i: Column) -> Column:
            anchor = anchor_at(form, first, i)
            whole = lambda w: F.xxhash64(F.lit(form), F.slice(read(form), i + 1, w))
            return F.transform(widths, lambda w: F.struct(place(form, i, w).alias("p"), anchor.alias("anchor"), whole(w).alias("hash")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(read(form)) - 1), one))

    no_place = F.array().cast("array<struct<form:int,at:int,width:int>>")
    # Consistency is a matter of one text; equal keys with different texts stay apart by its hash.
    t = t.withColumn("of", F.xxhash64("words"))
    if few:
        at = t.withColumn("ps", F.concat(*[places(*k) for k in kinds]) if kinds else no_place)
    else:
        near = t.select("key", "of", F.explode(F.concat(*[hashed_places(*k) for k in kinds])).alias("e")).select("key", "of", "e.*")
        known = windows.select("anchor").distinct()
        if known.count() <= BROADCAST_ANCHORS:
            near = near.join(F.broadcast(known), "anchor", "left_semi")
        hashes = windows.select("hash").distinct()
        near = near.select("key", "of", "p", "hash").join(hashes, "hash", "left_semi").groupBy("key", "of").agg(F.collect_set("p").alias("ps"))
        near, _ = written(spark, near.withColumnsRenamed({"key": "__key", "of": "__of"}), "window-places")
        same = F.col("key").eqNullSafe(F.col("__key")) & (F.col("of") == F.col("__of"))
        at = t.join(near, same)

    def sliced(p: Column) -> Column:
        """What a match needs of its place: the rest of the text is not carried along."""
        shaped = p["form"] == TEMPLATE
        cut = lambda c: F.slice(c, p["at"] + 1, p["width"])
        return F.struct(
            F.when(shaped, F.get("pos", p["at"])).otherwise(p["at"]).alias("doc_at"),
            p["form"].alias("form"),
            F.when(shaped, cut("template")).otherwise(cut("words")).alias("doc_window"),
            F.when(shaped, cut("slots")).otherwise(F.array().cast("array<string>")).alias("words"),
        )

    # Most texts have no place to look at: only the others number their slots.
    at = at.withColumn("pos", F.when(F.size("ps") > 0, places_of(F.col("s"))))
    made = at.select("key", "of", F.explode(F.transform("ps", sliced)).alias("w")).select("key", "of", "w.*")
    hashed = made.withColumn("hash", F.xxhash64("form", "doc_window"))
    joined = hashed.join(F.broadcast(windows) if few else windows, ["hash", "form"]).where(F.col("doc_window") == F.col("window"))
    one = lambda i: F.struct(F.get("window", i).alias("kind"), F.get("item_words", i).alias("item"), F.get("words", i).alias("doc"), F.get("pos", i).alias("pos"))
    filled = F.filter(F.transform(F.sequence(F.lit(0), F.size("window") - 1), one), lambda x: x["kind"].isin(NUMBER, NAME, UNIT))
    none = F.array().cast("array<struct<kind:string,item:string,doc:string,pos:int>>")
    return joined.select("key", "of", "item", "m", "n", "doc_at", "at", "len", F.when(F.col("form") == TEMPLATE, filled).otherwise(none).alias("slots"))


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = WIDTH, share: float = SHARE, enough: int = ENOUGH) -> DataFrame:
    """key, item, windows, coverage, changed_slots and kind of every leak: one row for each pair of document and item.

    Windows of one alignment (document word less item word), and those of alignments within a band, belong together.
    Their slots are consistent if each word of the item stands for one word of the document; else the windows whose slots
    take up the less frequent words don't count, and words that were refilled don't count as covered. ``windows`` is the
    number of item windows matched, ``coverage`` the larger share of windows or of covered words. ``kind`` is
    ``verbatim`` if no slot was refilled, else ``re-parameterised``. Null texts and texts without words leak nothing. A
    document that repeats an item has the best figures; repeated rows give one leak.
    """
    found = matches(spark, docs, items, key, text, item_key, item_text, width)
    found, _ = written(spark, few_files(found.distinct()), "window-matches")
    run = ["key", "of", "item", "grid", "cell"]
    shift = F.col("doc_at") - F.col("at")
    # Two grids of bands, half a band apart, so that offsets within half a band meet in one; and each offset alone.
    cells = F.array(*[F.struct(F.lit(g).alias("grid"), c.cast("long").alias("cell")) for g, c in enumerate((shift, F.floor(shift / BAND), F.floor((shift + BAND // 2) / BAND)))])
    found = found.select("*", F.explode(cells).alias("c")).select("*", "c.grid", "c.cell").drop("c")
    # The commonest document word for each item word of a run; ties to the greater word.
    slots = found.select(*run, F.explode("slots").alias("s")).groupBy(*run, "s.kind", F.col("s.item").alias("item_word"), F.col("s.doc").alias("doc_word")).agg(F.count("*").alias("c"))
    best = slots.groupBy(*run, "kind", "item_word").agg(F.max_by("doc_word", F.struct("c", F.col("doc_word"))).alias("doc_word"))
    chosen = best.groupBy(*run).agg(F.collect_set(F.struct("kind", F.col("item_word").alias("item"), F.col("doc_word").alias("doc"))).alias("chosen"), F.sum((F.col("item_word") != F.col("doc_word")).cast("int")).alias("changed"))
    fills = F.transform("slots", lambda s: F.struct(s["kind"].alias("kind"), s["item"].alias("item"), s["doc"].alias("doc")))
    fits = (F.size("slots") == 0) | F.coalesce(F.size(F.array_except(fills, "chosen")) == 0, F.lit(False))
    refilled = F.transform(F.filter("slots", lambda s: s["item"] != s["doc"]), lambda s: F.sequence(s["pos"], s["pos"] + F.length(s["item"]) - F.length(F.translate(s["item"], _JOIN, ""))))
    judged = found.join(chosen, run, "left").select(*run, "m", "n", fits.alias("fits"), F.struct("at", "len").alias("span"), F.flatten(refilled).alias("refilled"), "changed")
    aligned = judged.groupBy(*run, "m", "n").agg(
        F.collect_set(F.when(F.col("fits"), F.col("span"))).alias("spans"),
        F.flatten(F.collect_set(F.when(F.col("fits"), F.col("refilled")))).alias("refilled"),
        F.max(~F.col("fits")).alias("torn"),
        F.coalesce(F.max("changed"), F.lit(0)).alias("changed_slots"),
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    held = aligned.withColumn("covered", covered).withColumn("windows", F.size(F.array_distinct(F.transform("spans", lambda s: s["at"]))).cast("long"))
    held = held.withColumn("coverage", F.greatest(F.col("windows") / F.col("n"), F.size(F.when(F.col("torn"), F.array_except("covered", "refilled")).otherwise(F.col("covered"))) / F.col("m")))
    leaked = held.where((F.col("coverage") >= share) | (F.col("windows") >= enough))
    per = leaked.groupBy("key", "item").agg(F.max_by(F.struct("windows", "coverage", "changed_slots"), F.struct("coverage", "windows", -F.col("changed_slots"))).alias("b"))
    return per.select(
        F.col("key").alias(key),
        F.col("item").alias(item_key),
        F.col("b.windows").alias("windows"),
        F.col("b.coverage").alias("coverage"),
        F.col("b.changed_slots").cast("long").alias("changed_slots"),
        F.when(F.col("b.changed_slots") > 0, "re-parameterised").otherwise("verbatim").alias("kind"),
    )


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that leak an item. Rows with a null key stay."""
    bad = leaks(spark, docs, items, key=key, **options).select(F.col(key).alias("__leaked")).distinct()
    return docs.join(bad, F.col(key) == F.col("__leaked"), "left_anti")


def op2(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, windows, coverage, changed_slots and kind of every leak."""
    return leaks(spark, docs.select("doc_id", "text"), items.select("item_id", "text"))
