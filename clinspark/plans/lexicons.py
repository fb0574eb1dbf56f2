"""Correction in passes, phrase evidence and linkage by a cascade of rules, with lexicons and records that are taken from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspark.operators import concepts, evidence, linkage, passes, rule_table
from clinspark.sources.store import cut_lineage, scan
from clinspark.streaming import keyed

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def misread_texts(spark, d):
    """Conversations as a recogniser may give them: m as rn, l as 1, i as l, or a letter lost in long words, by turn."""
    t, k = F.col("text"), F.col("turn") % 4
    lost = F.regexp_replace(t, "([A-Za-z])[a-z]([a-z]{6,})", "$1$2")
    seen = F.when(k == 0, F.replace(t, F.lit("m"), F.lit("rn"))).when(k == 1, F.replace(t, F.lit("l"), F.lit("1"))).when(k == 2, F.regexp_replace(t, "([a-z])i([a-z])", "$1l$2")).otherwise(lost)
    return scan(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("truth"), seen.alias("seen"))


def lexicon_tables(spark, d):
    """Confusables, phrases, dictionary and known words for :func:`misread_texts`: fixed parts, and what the texts themselves hold."""
    texts = scan(spark, d, "conversations").select(F.sha2("text", 256).alias("row"), "role", "text").where("text IS NOT NULL")
    words = cut_lineage(passes.words_of(texts).select(F.lower("core").alias("word")).where("length(word) >= 3 AND word RLIKE '^[a-z]+$'").distinct())  # two tables are made of them
    confusables = spark.createDataFrame([("ß", "ss", False), ("êé", "ée", False), ("ê", "e", False), ("tz", "z", True)], "seen string, meant string, whole boolean")
    dictionary = words.select(F.regexp_replace("word", "^([a-z])[a-z]([a-z]{6,})$", "$1$2").alias("seen"), F.col("word").alias("meant")).where("seen <> meant")
    opening = F.slice(F.split("text", "[ \\n]+"), 1, 2)
    phrases = texts.where("role = 'system'").select(F.array_join(opening, " ").alias("seen"), F.upper(F.array_join(opening, "_")).alias("meant"))
    return confusables, phrases, dictionary, words


@query()
def correction_passes(spark, d):
    """Misread conversations corrected by confusables, phrases, dictionary and repaired spellings, with a list of changes and flags."""
    out = passes.correct(misread_texts(spark, d), "seen", *lexicon_tables(spark, d))
    return out.select("conv_id", "turn", "corrected", "corrections", "flags")


_TOKENS = """list_filter(list_transform(regexp_split_to_array(text, '[ \\t\\r\\n,;/|]+'), lambda x: regexp_replace(x, '^[.:()\\[\\]"'']+|[.:()\\[\\]"'']+$', '', 'g')), lambda x: x <> '')"""


@query(f"""
WITH t AS (SELECT conv_id, turn, role, {_TOKENS} AS w FROM conversations),
g AS (SELECT conv_id, turn, role, i, n, w[i:i + n - 1] AS p FROM (SELECT t.*, unnest(range(1, len(w) + 1)) AS i FROM t) t, range(1, 5) r(n) WHERE i + n - 1 <= len(w)),
k AS (SELECT *, regexp_replace(upper(array_to_string(p, ' ')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM g),
lex AS (SELECT key, min(array_to_string(p, ' ')) AS term FROM k WHERE role = 'assistant' AND i BETWEEN 3 AND 5 AND key <> '' GROUP BY key),
h AS (SELECT conv_id, turn, term, i, n FROM k JOIN lex USING (key) WHERE role = 'user'),
f AS (SELECT conv_id, turn, list_reduce(list({{'taken': range(i, i + n), 'start': [i], 'terms': [term]}} ORDER BY n DESC, i),
        lambda s, x: CASE WHEN list_has_any(s.taken, x.taken) THEN s ELSE {{'taken': list_concat(s.taken, x.taken), 'start': list_concat(s.start, x.start), 'terms': list_concat(s.terms, x.terms)}} END) AS s FROM h GROUP BY ALL)
SELECT conv_id, turn, list_transform(list_sort(list_transform(range(1, len(s.start) + 1), lambda j: {{'a': s.start[j], 'b': s.terms[j]}})), lambda x: x.b) AS found, list_contains(s.start, 1) AS leads FROM f""")
def phrase_evidence(spark, d):
    """Phrases of answers in questions: the longest first over the whole text, none overlapping."""
    texts = scan(spark, d, "conversations")
    answers = texts.where("role = 'assistant'").select(F.sha2("text", 256).alias("row"), evidence.phrase_tokens(F.col("text")).alias("words"))
    lexicon = evidence.runs(answers, 4).where("start BETWEEN 2 AND 4").select(F.col("phrase").alias("term"))
    out = evidence.evidence(texts.where("role = 'user'").select("conv_id", "turn", "text"), "text", lexicon)
    return out.where(F.size("found") > 0).select("conv_id", "turn", F.transform("found", lambda h: h["term"]).alias("found"), "leads")


def ward_records(spark, d):
    """Customers as records of a ward: few have a bed, some a number; names repeat with slips, ages and treatments come from the balance and the segment."""
    k = F.col("c_custkey")
    letters = F.translate(F.substring(F.md5((k % 900).cast("string")), 1, 10), "0123456789", "ghijklmnop")
    whole = F.when(k % 3 == 0, letters).otherwise(F.concat(F.substring(letters, 1, 5), F.lit(" "), F.substring(letters, 6, 5)))
    name = F.when(k % 8 == 0, None).when(k % 7 == 0, F.concat(F.substring(whole, 1, 2), F.substring(whole, 4, 20))).when(k % 11 == 0, F.substring(whole, 1, 6)).otherwise(whole)
    years = (F.floor(F.abs("c_acctbal")) % 90).cast("int")
    return scan(spark, d, "customer").select(
        "c_custkey", F.when(k % 4 == 0, F.concat(F.lit("B"), (k % 700).cast("string"))).alias("bed"), F.when(k % 9 == 0, (k % 1000 + 200_000_000_000).cast("string")).alias("civil_id"), name.alias("full_name"),
        F.when(k % 13 == 0, None).when(k % 2 == 0, "F").otherwise("M").alias("gender"), F.when(k % 10 == 0, None).otherwise(years).alias("age"),
        F.when(k % 6 == 0, None).when(k % 5 < 2, F.col("c_mktsegment")).otherwise(F.concat_ws(" ", F.lit("acute"), "c_mktsegment", (F.col("c_nationkey") % 7).cast("string"))).alias("dx"),
        F.when(k % 12 == 0, None).otherwise(F.concat(F.lit("drug "), (k % 41).cast("string"))).alias("meds"),
    )


@query("""
WITH RECURSIVE k AS (SELECT c_custkey, translate(substr(md5(CAST(c_custkey % 900 AS VARCHAR)), 1, 10), '0123456789', 'ghijklmnop') AS l, CAST(floor(abs(c_acctbal)) AS BIGINT) % 90 AS years, c_mktsegment, c_nationkey FROM customer),
w AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN l ELSE substr(l, 1, 5) || ' ' || substr(l, 6, 5) END AS whole FROM k),
r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'B' || (c_custkey % 700) END AS bed, CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey % 1000 + 200000000000 AS VARCHAR) END AS civil,
  upper(CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN substr(whole, 1, 2) || substr(whole, 4, 20) WHEN c_custkey % 11 = 0 THEN substr(whole, 1, 6) ELSE whole END) AS raw,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS g, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE years END AS age,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 5 < 2 THEN c_mktsegment ELSE 'ACUTE' || c_mktsegment || (c_nationkey % 7) END AS dx, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE 'DRUG' || (c_custkey % 41) END AS meds FROM w),
n AS (SELECT *, trim(raw) AS name, contains(trim(raw), ' ') AS several FROM r),
p AS (SELECT a.id AS x, b.id AS y, a.bed IS NOT NULL AND b.bed IS NOT NULL AS beds, a.bed = b.bed AS one_bed, (a.bed IS NULL) <> (b.bed IS NULL) AS missing_one, a.civil = b.civil AS one_number,
  a.g IS NULL OR b.g IS NULL OR a.g = b.g AS fit, abs(a.age - b.age) AS gap, levenshtein(a.name, b.name) AS d, a.name IS NULL OR b.name IS NULL OR a.bed IS NULL OR b.bed IS NULL AS partial,
  coalesce(contains(a.dx, b.dx) OR contains(b.dx, a.dx), false) AS dxs, coalesce(contains(a.meds, b.meds) OR contains(b.meds, a.meds), false) AS drugs, a.dx IS NULL OR b.dx IS NULL AS no_dx, a.meds IS NULL OR b.meds IS NULL AS no_drugs,
  NOT (a.several AND b.several) AND least(length(a.name), length(b.name)) < 8 AS short FROM n a JOIN n b ON a.id < b.id),
e AS (SELECT x, y FROM p WHERE CASE WHEN beds THEN one_bed WHEN one_number IS NOT NULL THEN one_number WHEN d <= 1 AND missing_one AND fit THEN true WHEN NOT fit THEN false WHEN gap > 8 THEN false
  WHEN partial AND gap <= 1 AND ((dxs AND (drugs OR no_drugs)) OR (drugs AND (dxs OR no_dx))) THEN true WHEN d IS NULL THEN false WHEN d <= CASE WHEN short THEN 1 ELSE 2 END THEN true
  ELSE NOT short AND (gap IS NULL OR gap <= 2) AND d <= 4 END),
s AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), reach AS (SELECT id, id AS g FROM r UNION SELECT s.y, reach.g FROM reach JOIN s ON s.x = reach.id)
SELECT id AS c_custkey, min(g) AS "group" FROM reach GROUP BY id""")
def record_linkage(spark, d):
    """Records of one person by the whole cascade of rules, with plain edits between names."""
    return linkage.link(ward_records(spark, d), "c_custkey", spark.createDataFrame([], "a string, b string, cost double"))


@query("""
WITH RECURSIVE pairs AS (SELECT DISTINCT lower(p_brand) AS a, lower(p_type) AS b FROM part WHERE p_partkey % 3 = 0), s AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS term, a AS c FROM s UNION SELECT s.b, reach.c FROM reach JOIN s ON s.a = reach.term), known AS (SELECT term, min(c) AS concept FROM reach GROUP BY term),
said AS (SELECT p_partkey, trim(lower(CASE p_partkey % 4 WHEN 0 THEN 'Acute  severe ' || p_type WHEN 1 THEN p_type || ' left' WHEN 2 THEN p_brand ELSE p_name END)) AS k FROM part),
f AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(k, ' +', ' ', 'g'), '^((acute|severe) )+', ''), '( left)+$', '') AS k FROM said)
SELECT p_partkey, known.term, concept FROM f LEFT JOIN known ON known.term = f.k""")
def concept_lookup(spark, d):
    """What is said of parts, looked up past qualifiers among concepts that pairs of brands and types connect."""
    part, k = scan(spark, d, "part"), F.col("p_partkey") % 4
    known = concepts.concepts(part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("a"), F.col("p_type").alias("b")))
    said = F.when(k == 0, F.concat(F.lit("Acute  severe "), "p_type")).when(k == 1, F.concat("p_type", F.lit(" left"))).when(k == 2, F.col("p_brand")).otherwise(F.col("p_name"))
    return concepts.resolve(part.select("p_partkey", said.alias("said")), "said", known).select("p_partkey", "term", "concept")


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '\\p{L}{7,}'))) AS w FROM benchmark),
m AS (SELECT doc_id, w, text, '(?i)(?:^|[^\\p{L}])(' || w || ') +(\\p{L}+)' AS p FROM documents JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents) d USING (doc_id) JOIN w USING (w))
SELECT doc_id, w AS rule, regexp_extract(text, p, 1) AS found, regexp_extract(text, p, 2) AS next FROM m WHERE regexp_matches(text, p)""")
def rule_matches(spark, d):
    """A rule for every longer word of the benchmark, over all documents: the word with what follows it."""
    words = scan(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("\\p{L}{7,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("rule")).distinct()
    rules = words.select("rule", F.concat(F.lit("(?i)(?:^|[\\W\\d_])("), "rule", F.lit(") +([^\\W\\d_]+)")).alias("pattern"), F.lit("follows").alias("infers"), F.array("rule").alias("anchors"))
    out = rule_table.matches(scan(spark, d, "documents"), "doc_id", "text", rules)
    return out.select("doc_id", "rule", F.get("groups", 0).alias("found"), F.get("groups", 1).alias("next"))


@query("""
SELECT user_id, count(*) AS seen, list_reverse(list(event_id ORDER BY ts DESC, event_id DESC)[1:5]) AS kept FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def stream_buffers(spark, d):
    """The last five events of each user, kept by a stream in keyed state; they end as the batch has them."""
    return keyed.buffered_events(spark, d).select("user_id", "seen", F.transform("kept", lambda x: x["event_id"]).alias("kept"))
