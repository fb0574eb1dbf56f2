"""Cross-site boilerplate: lines that spread over many distinct sites are taken out of the documents that carry them.

1. Every line of at least ``min_words`` words is counted by its hash; lines that are rare, or of one site alone, can't
   spread, and go (an exact condition: as many distinct sites need as many occurrences). Counts pre-aggregate per task.
2. The sites of each remaining line's occurrences go into HyperLogLog sketches, one per task and line, which aggregation
   merges.
3. Lines whose estimate lies near the threshold get the exact distinct count; far ones are decided by the estimate.
4. A document loses its spread lines, whatever their share, unless it is as a whole a copy of others: then its lines lie on
   many sites because it does, and near-duplicate detection has to judge it. It is one if ``copy_share`` of its words lie
   in spread lines, or in lines of which other such documents hold a piece. (Two documents that share 8/9 of their words
   have a similarity of 0.8.) Only documents of which spread lines make up ``copy_from`` or more are asked.

All of it is DataFrame operations. A line on a third of all documents is never gathered: it meets others only in
pre-aggregated counts and sketches, and in joins that are split at run time or broadcast below a checked size. While the
spread lines are few, each text is judged where it lies; beyond, their places are joined to it. Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.common import few_files, without, written

MIN_WORDS = 3
#: Lines of at least LONG_WORDS words are passages: they hardly recur by chance, so fewer sites make them spread.
MIN_SITES = 8
LONG_WORDS = 20
LONG_SITES = 3
COPY_FROM = 0.2
COPY_SHARE = 8 / 9
#: Words of a line's pieces, the first and the last ones of it.
PIECE = 5
#: Sketches of 2**LG_K registers, and the band around a threshold in which they aren't trusted.
LG_K = 8
BAND = 0.35
#: Rows of hashes that a broadcast may hold (16 to 32 bytes each); beyond, the join shuffles.
BROADCAST_LINES = 500_000
#: Spread lines that are put into the plan as a set.
SET_LINES = 20_000


def lines_of(text: Column) -> Column:
    """The lines of a text, without white space at either end."""
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))


def words_of(line: Column) -> Column:
    """One more than the spaces of a line; none in an empty one."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1)


def line_keys(text: Column) -> Column:
    """For each line of a text, in order: struct of its 64-bit hash and its number of words."""
    return F.transform(lines_of(text), lambda x: F.struct(F.xxhash64(x).alias("h"), words_of(x).alias("w")))


def spread_lines(spark: SparkSession, docs: DataFrame, text: str = "text", site: str = "source", min_words: int = MIN_WORDS, min_sites: int = MIN_SITES, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES) -> DataFrame:
    """h: hashes of the lines that lie on at least as many distinct sites as their length asks for. Null sites don't count."""
    lines = docs.where(F.col(site).isNotNull()).select(F.xxhash64(F.col(site)).alias("site"), F.explode(line_keys(F.col(text))).alias("k")).select("site", "k.h", "k.w").where(F.col("w") >= min_words)
    need = F.when(F.col("w") >= long_words, long_sites).otherwise(min_sites)
    seen = lines.groupBy("h", "w").agg(F.count("*").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi"))
    likely, _ = written(spark, few_files(seen.where((F.col("n") >= need) & ((F.col("lo") != F.col("hi")) | (need <= 1))).select("h", "w")), "likely-lines")
    few = likely.count() <= BROADCAST_LINES
    found, _ = written(spark, lines.join(F.broadcast(likely) if few else likely, ["h", "w"]), "line-occurrences")
    sketched = found.groupBy("h", "w").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    decided, _ = written(spark, few_files(sketched.withColumn("near", F.abs(F.col("sites") - need) <= need * BAND)), "line-estimates")
    sure = decided.where(~F.col("near") & (F.col("sites") >= need)).select("h")
    near = decided.where("near").select("h", "w")
    exact = found.join(F.broadcast(near) if few else near, ["h", "w"]).groupBy("h", "w").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= need).select("h")
    return sure.union(exact).distinct()


def marked_lines(spark: SparkSession, docs: DataFrame, spread: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with __t (the text's hash), __lines (:func:`line_keys`) and __marks: whether each line is spread. Marks may be null, or end with the last spread line."""
    keyed = docs.withColumns({"__t": F.xxhash64(text), "__lines": line_keys(F.col(text))})
    known = spread.limit(SET_LINES + 1).collect()  # hashes of at most SET_LINES + 1 lines
    if len(known) <= SET_LINES:
        hashes = [r["h"] for r in known]
        return keyed.withColumn("__marks", F.transform("__lines", lambda k: k["h"].isin(hashes)) if hashes else F.lit(None).cast("array<boolean>"))
    few = spread.count() <= BROADCAST_LINES
    # Texts are told apart by key and hash, and only places are shuffled.
    at = keyed.select(F.col(key).alias("__k"), "__t", F.posexplode("__lines").alias("__p", "k")).select("__k", "__t", "__p", F.col("k.h").alias("h"))
    hits = at.join(F.broadcast(spread) if few else spread, "h").groupBy("__k", "__t").agg(F.sort_array(F.collect_set("__p")).alias("s"))
    # One mark for each line up to the last that is hit, so that lines and marks pair up in one pass however many there are.
    mark = F.transform("s", lambda p, i: F.concat(F.repeat(F.lit("0"), p - F.when(i > 0, F.get(F.col("s"), i - 1)).otherwise(-1) - 1), F.lit("1")))
    places = hits.select(F.col("__k").alias("__k2"), F.col("__t").alias("__t2"), F.transform(F.split(F.array_join(mark, ""), ""), lambda m: m == "1").alias("__marks"))
    return keyed.join(places, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("__t") == F.col("__t2")), "left").drop("__k2", "__t2")


def pieces_of(line: Column) -> Column:
    """The first and the last words of a line, twice ``PIECE`` of each if it has so many; a shorter line is one piece."""
    words = F.split(line, " ")
    cut = lambda at: F.array_join(F.slice(words, at, PIECE), " ")
    return F.when(F.size(words) < PIECE, F.array(line)).when(F.size(words) < 2 * PIECE, F.array(cut(1), cut(-PIECE))).otherwise(F.array(cut(1), cut(1 + PIECE), cut(-PIECE), cut(-2 * PIECE)))


def whole_copies(spark: SparkSession, marked: DataFrame, key: str, text: str, copy_from: float, copy_share: float) -> DataFrame:
    """__k, __t: documents that are copies as a whole although spread lines make up less than ``copy_share`` of them."""
    asked = marked.where((F.col("__lost") > 0) & (F.col("__lost") >= F.col("__total") * copy_from))
    all_lines = F.zip_with(lines_of(F.col(text)), "__marks", lambda x, m: F.struct(x.alias("x"), m.eqNullSafe(True).alias("hit")))
    lines = asked.select(F.col(key).alias("__k"), "__t", "__lost", "__total", F.posexplode(all_lines).alias("p", "line")).where("line.x <> ''")
    pieces = lines.select("__k", "__t", "__lost", "__total", "p", "line.hit", words_of(F.col("line.x")).alias("w"), F.explode(F.transform(pieces_of(F.col("line.x")), lambda x: F.xxhash64(x))).alias("piece"))
    pieces, _ = written(spark, pieces.withColumn("doc", F.xxhash64("__k", "__t")), "line-pieces")
    shared = pieces.groupBy("piece").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("piece")
    near = pieces.where(~F.col("hit") & (F.col("__lost") < F.col("__total") * copy_share)).join(shared, "piece").groupBy("__k", "__t", "__lost", "__total", "p").agg(F.max("w").alias("w"))
    return near.groupBy("__k", "__t", "__lost", "__total").agg(F.sum("w").alias("w")).where(F.col("__lost") + F.col("w") >= F.col("__total") * copy_share).select("__k", "__t")


def remove_boilerplate(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", copy_from: float = COPY_FROM, copy_share: float = COPY_SHARE, **limits: int) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and the columns n_removed and is_copy.

    Null texts stay null. A text that loses nothing stays as it is, byte for byte; another keeps its other lines as they
    are, joined by newlines. Repeated rows are treated alike. Clashing columns of the new names are replaced. An empty
    table stays one. Texts are taken whole, however long.
    """
    spread, _ = written(spark, few_files(spread_lines(spark, docs, text, site, **limits)), "spread-lines")
    kept = without(docs, "n_removed", "is_copy")
    marked = marked_lines(spark, kept, spread, key, text)
    hit = F.filter(F.zip_with("__lines", "__marks", lambda k, m: F.when(m, k["w"])), lambda w: w.isNotNull())
    marked = marked.withColumn("__hit", F.coalesce(hit, F.array().cast("array<int>"))).withColumns(
        {"__lost": F.aggregate("__hit", F.lit(0), lambda a, w: a + w), "__total": F.aggregate("__lines", F.lit(0), lambda a, k: a + k["w"])}
    )
    copies, _ = written(spark, few_files(whole_copies(spark, marked, key, text, copy_from, copy_share)), "whole-copies")
    few = copies.count() <= BROADCAST_LINES
    copies = copies.select(F.col("__k").alias("__k2"), F.col("__t").alias("__t2"), F.lit(True).alias("__whole"))
    joined = marked.join(F.broadcast(copies) if few else copies, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("__t") == F.col("__t2")), "left")
    has = F.coalesce(F.size("__hit") > 0, F.lit(False))
    copy = has & (F.col("__whole").isNotNull() | (F.col("__lost") >= F.col("__total") * copy_share))
    cut = joined.withColumns({"__has": has, "__copy": copy})
    rest = F.filter(F.zip_with(F.split(F.col(text), "\n"), "__marks", lambda x, m: F.when(~m.eqNullSafe(True), x)), lambda x: x.isNotNull())
    drop = F.col("__has") & ~F.col("__copy")
    out = {text: F.when(drop, F.array_join(rest, "\n")).otherwise(F.col(text)), "n_removed": F.when(drop, F.size("__hit")).otherwise(0), "is_copy": F.col("__copy")}
    return cut.withColumns(out).select(*[F.col(f"`{c}`") for c in kept.columns], "n_removed", "is_copy")


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, n_removed and is_copy of every document."""
    return remove_boilerplate(spark, docs.select("doc_id", "text", "source")).select("doc_id", "text", "n_removed", "is_copy")


_W = "string_split(line, ' ')"
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, text, source, i, string_split(text, chr(10))[i] AS raw,
         trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, text, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), worded AS (
  SELECT *, CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS w FROM lines
), spread AS (
  SELECT line FROM worded WHERE w >= {MIN_WORDS} AND source IS NOT NULL GROUP BY line, w
  HAVING count(DISTINCT source) >= CASE WHEN w >= {LONG_WORDS} THEN {LONG_SITES} ELSE {MIN_SITES} END
), marked AS (
  SELECT *, line IN (SELECT line FROM spread) AS hit FROM worded
), judged AS (
  SELECT doc_id, text, count(*) FILTER (hit) AS hits, coalesce(sum(w) FILTER (hit), 0) AS lost, sum(w) AS total,
         string_agg(raw, chr(10) ORDER BY i) FILTER (NOT hit) AS rest
  FROM marked GROUP BY doc_id, text
), pieces AS (
  SELECT doc_id, text, lost, total, i, w, hit, unnest(CASE WHEN w < {PIECE} THEN [line]
    WHEN w < {2 * PIECE} THEN [array_to_string({_W}[1:{PIECE}], ' '), array_to_string({_W}[-{PIECE}:], ' ')]
    ELSE [array_to_string({_W}[1:{PIECE}], ' '), array_to_string({_W}[{PIECE + 1}:{2 * PIECE}], ' '), array_to_string({_W}[-{PIECE}:], ' '), array_to_string({_W}[-{2 * PIECE}:-{PIECE + 1}], ' ')] END) AS piece
  FROM marked JOIN judged USING (doc_id, text) WHERE line <> '' AND lost > 0 AND lost >= {COPY_FROM} * total
), shared AS (
  SELECT piece FROM pieces GROUP BY piece HAVING count(DISTINCT (doc_id, text)) > 1
), near AS (
  SELECT doc_id, text, sum(w) AS w FROM (SELECT DISTINCT doc_id, text, i, w FROM pieces SEMI JOIN shared USING (piece) WHERE NOT hit) GROUP BY 1, 2
), copied AS (
  SELECT j.*, hits > 0 AND lost + coalesce(near.w, 0) >= {COPY_SHARE!r}::DOUBLE * total AS whole FROM judged j LEFT JOIN near ON j.doc_id = near.doc_id AND j.text = near.text
)
SELECT doc_id, CASE WHEN hits > 0 AND NOT whole THEN coalesce(rest, '') ELSE text END AS text,
       CAST(CASE WHEN hits > 0 AND NOT whole THEN hits ELSE 0 END AS INTEGER) AS n_removed, whole AS is_copy
FROM copied
UNION ALL SELECT doc_id, text, 0, FALSE FROM documents WHERE text IS NULL
"""
