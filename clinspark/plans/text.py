"""Text keys, vocabularies, edit distances, rules, extraction and corpus preparation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinspark.functions import distance
from clinspark.functions.scalar import bed_key, canonical_token, cer, civil_id_key, fix_digraphs, js_round, list_values, metric_key, name_key, preserve_case, text_density
from clinspark.operators import fuzzy, learning, records, text_rules, weighted
from clinspark.sources.store import cut_lineage, scan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DENSITY = "length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g'))"


@query(f"""
WITH d AS (SELECT source, doc_id, {_DENSITY} AS density FROM documents WHERE length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g')) > 0),
j AS (SELECT source, density, quality, CASE WHEN density >= 0.85 THEN 'HIGH' WHEN density >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM d LEFT JOIN labels USING (doc_id))
SELECT source, count(*) AS n, count(*) FILTER (band = 'HIGH') AS high, count(*) FILTER (band = 'MEDIUM') AS medium, count(*) FILTER (band = 'LOW') AS low,
       count(quality) AS labelled, round(avg(density), 6) AS mean_density, round(avg(quality), 6) AS mean_quality FROM j GROUP BY source""")
def document_quality_profile(spark, d):
    """Text density and its bands for each source, next to the reviewed quality."""
    from clinspark.functions.scalar import confidence_band

    docs = scan(spark, d, "documents").select("doc_id", "source", text_density(F.col("text")).alias("density")).where("density IS NOT NULL")
    j = docs.join(scan(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("band", confidence_band(F.col("density")))
    count = lambda b: F.count_if(F.col("band") == b)
    return j.groupBy("source").agg(
        F.count("*").alias("n"), count("HIGH").alias("high"), count("MEDIUM").alias("medium"), count("LOW").alias("low"),
        F.count("quality").alias("labelled"), F.round(F.avg("density"), 6).alias("mean_density"), F.round(F.avg("quality"), 6).alias("mean_quality"),
    )


@query("""
SELECT c_custkey, translate(upper(c_name), 'OQDIL|!ZSGTB', '000111125678') AS token, translate(upper(replace(c_name, ' ', '')), 'OQ|IL', '00111') AS bed,
       translate(replace(replace(c_name, ' ', ''), '-', ''), 'OoIl|', '00111') AS civil,
       upper(trim(regexp_replace(regexp_replace(c_name, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))) AS name FROM customer""")
def canonical_keys(spark, d):
    n = F.col("c_name")
    return scan(spark, d, "customer").select("c_custkey", canonical_token(n).alias("token"), bed_key(n).alias("bed"), civil_id_key(n).alias("civil"), name_key(n).alias("name"))


@query("""
WITH t AS (SELECT regexp_replace(unnest(string_split(text, ' ')), '[^A-Za-z]', '', 'g') AS w FROM conversations),
v AS (SELECT lower(w) AS word, w AS variant, count(*) AS c FROM t WHERE w <> '' GROUP BY ALL)
SELECT word, CAST(sum(c) AS BIGINT) AS n, arg_max(variant, (c, -rank)) AS preferred FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY c DESC, variant) AS rank FROM v) GROUP BY word""")
def vocab_counts(spark, d):
    """Words, their counts and their commonest spelling."""
    t = scan(spark, d, "conversations").select(F.explode(F.split("text", " ")).alias("w")).select(F.regexp_replace("w", "[^A-Za-z]", "").alias("w"))
    return learning.vocabulary(t, "w")


_WORDS = "list_filter(string_split(regexp_replace(lower(p_name), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '')"


@query("""
WITH p AS (SELECT p_partkey, lower(p_name) AS truth, replace(replace(replace(replace(replace(replace(replace(lower(p_name), 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), 'nn', 'm'), 'ii', 'u'), 'li', 'h'), 'ri', 'n') AS seen FROM part)
SELECT p_partkey, seen, round(levenshtein(seen, truth) / length(truth), 6) AS cer FROM p""")
def character_error_rate(spark, d):
    truth = F.lower("p_name")
    return scan(spark, d, "part").select("p_partkey", fix_digraphs(truth).alias("seen"), F.round(cer(fix_digraphs(truth), truth), 6).alias("cer"))


@query()
def word_error_rate(spark, d):
    """Words of a text against the same text with look-alike characters."""
    docs = scan(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("truth"))
    noisy = docs.withColumn("seen", text_rules.noisy(F.col("truth"), F.col("turn"), 0.02, {"o": "0", "l": "1", "s": "5"}))
    return distance.word_error_rate(noisy, "seen", "truth").select("conv_id", "turn", F.round("wer", 6).alias("wer"))


@query("""
WITH lex AS (SELECT DISTINCT s_name AS term FROM supplier), q AS (SELECT c_custkey, c_name FROM customer),
m AS (SELECT c_custkey, term, levenshtein(replace(c_name, 'Customer', 'Supplier'), term) AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY levenshtein(replace(c_name, 'Customer', 'Supplier'), term), term) AS r
      FROM q JOIN lex ON abs(length(replace(c_name, 'Customer', 'Supplier')) - length(term)) <= 2)
SELECT c_custkey, term, CAST(dist AS INTEGER) AS dist FROM m WHERE r = 1 AND dist <= 2""")
def fuzzy_lexicon_match(spark, d):
    """The nearest term within two edits, by deletion neighbourhoods."""
    lex = scan(spark, d, "supplier").select(F.col("s_name").alias("term"))
    q = scan(spark, d, "customer").select("c_custkey", F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier")).alias("seen"))
    return q.join(fuzzy.nearest_terms(q, "seen", lex, "term", 2), "seen").select("c_custkey", "term", F.col("distance").alias("dist"))


@query()
def ocr_distance_match(spark, d):
    """The nearest name of a lexicon by confusion-aware distance of at most 2; edits of forms with one letter for each group bound it from below."""
    lex = scan(spark, d, "supplier").select(F.col("s_name").alias("term"))
    q = scan(spark, d, "customer").select("c_custkey", F.replace(F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supp1ier")), F.lit("0"), F.lit("O")).alias("seen"))
    near = weighted.nearest(q, "seen", lex, "term", spark.createDataFrame(weighted.confusable_costs(), "a string, b string, cost double"), 2.0)
    return q.join(near, "seen").select("c_custkey", "term", F.round("distance", 6).alias("dist"))


def misread(word):
    """A word as a recogniser may read it, decided by its hash: one kind of letter taken for another, or a letter lost."""
    h = F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long")
    lost = F.concat(F.substring(word, 1, 2), F.substring(word, 4, 1 << 20))
    return F.when(h % 5 == 0, F.translate(word, "o", "0")).when(h % 5 == 1, F.translate(word, "ln", "1h")).when(h % 5 == 2, F.translate(word, "e", "c")).when(h % 5 == 3, lost).otherwise(word)


@query()
def learned_distance_match(spark, d):
    """Words as misread, matched with the vocabulary by costs that were learned from the other half of the words."""
    words = scan(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("truth")).where("length(truth) >= 5").distinct()
    both = words.select("truth", misread(F.col("truth")).alias("seen"), (F.conv(F.substring(F.md5("truth"), 7, 6), 16, 10).cast("long") % 2).alias("half"))
    pairs = cut_lineage(both)
    corrected = pairs.where("half = 0 AND seen <> truth AND length(seen) = length(truth)")
    confusions = learning.char_confusions(corrected, "truth", "seen").select(F.col("truth_char").alias("a"), F.col("seen_char").alias("b"), "n")
    costs = weighted.learned_costs(confusions, corrected.count())
    asked = pairs.where("half = 1")
    near = weighted.nearest(asked, "seen", pairs.select(F.col("truth").alias("term")), "term", costs, 1.5)
    return asked.join(near, "seen").select("truth", "seen", "term", F.round("distance", 6).alias("dist"))


@query("""
WITH w AS (SELECT unnest(string_split(lower(text), ' ')) AS t FROM conversations), c AS (SELECT t, replace(t, 'th', 'ht') AS s FROM w WHERE t <> ''),
x AS (SELECT t, s, unnest(range(1, least(length(t), length(s), 100) + 1)) AS i FROM c)
SELECT t[i] AS truth_char, s[i] AS seen_char, count(*) AS n FROM x WHERE t[i] <> s[i] GROUP BY 1, 2""")
def char_confusion(spark, d):
    w = scan(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("t")).where("t <> ''").withColumn("s", F.replace(F.col("t"), F.lit("th"), F.lit("ht")))
    return learning.char_confusions(w, "t", "s")


@query("""
SELECT event_type AS seen, CAST(count(*) AS BIGINT) AS n, arg_max(user_id, (ts, user_id)) AS latest FROM events GROUP BY 1""")
def word_corrections(spark, d):
    e = scan(spark, d, "events").withColumnRenamed("event_type", "seen")
    return learning.corrections(e, "seen", "user_id", "ts").select("seen", "n", "latest")


_RULE_SQL = " ".join(f"WHEN regexp_matches(t, '{text_rules.whole_words(r.pattern)}') THEN '{r.code}'" for r in sorted(text_rules.TRIAGE_RULES, key=lambda r: -r.severity))
_OUT_SQL = " ".join(f"WHEN '{r.code}' THEN '{r.outcome}'" for r in text_rules.TRIAGE_RULES)
_DX = "['stemi', 'nstemi with copd', 'uti', 'stable, for observation', 'pe01', 'septic shock', 'nothing', 'pe and uti']"


@query(f"""
WITH o AS (SELECT o_orderkey, ({_DX})[CAST(o_orderkey % 8 AS INTEGER) + 1] AS t FROM orders), m AS (SELECT o_orderkey, t, CASE {_RULE_SQL} END AS rule FROM o)
SELECT o_orderkey, t AS text, rule, CASE rule {_OUT_SQL} END AS outcome FROM m""")
def rule_engine(spark, d):
    """Triage suggestions for texts; null where no rule speaks."""
    texts = F.array(*[F.lit(x.strip().strip("'")) for x in ("stemi", "nstemi with copd", "uti", "stable, for observation", "pe01", "septic shock", "nothing", "pe and uti")])
    o = scan(spark, d, "orders").select("o_orderkey", F.get(texts, (F.col("o_orderkey") % 8).cast("int")).alias("text"))
    found = text_rules.apply_rules(F.col("text"))
    return o.select("o_orderkey", "text", found["rule"].alias("rule"), found["outcome"].alias("outcome"))


_MASK_SQL = "text"
for _n, _p in text_rules.IDENTIFIERS:
    _MASK_SQL = f"regexp_replace({_MASK_SQL}, '{text_rules.plain_pattern(_p)}', '{'{}1'.format(chr(92)) if _n == 'MRN' else ''}[{_n}]', 'g')"


@query(f"SELECT doc_id, md5({_MASK_SQL}) AS masked, {_MASK_SQL} <> text AS changed FROM documents WHERE text IS NOT NULL")
def pii_shield(spark, d):
    m = text_rules.mask(F.col("text"))
    return scan(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(m).alias("masked"), (m != F.col("text")).alias("changed"))


def _vault_sql() -> str:
    text, found = "text", []
    for name, pattern in text_rules.IDENTIFIERS:
        plain = text_rules.plain_pattern(pattern)
        value = "regexp_extract(v, '[0-9]+$')" if name == "MRN" else "v"
        found.append(f"list_transform(regexp_extract_all({text}, '{plain}'), lambda v: {{'kind': '{name}', 'value': {value}}})")
        text = f"regexp_replace({text}, '{plain}', '{chr(92) + '1' if name == 'MRN' else ''}[{name}]', 'g')"
    return f"""
WITH f AS (SELECT doc_id, unnest(list_concat({", ".join(found)})) AS v, generate_subscripts(list_concat({", ".join(found)}), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, '[' || v.kind || '_' || lpad(CAST(i AS VARCHAR), 4, '0') || ']' AS token, sha256(v.value) AS hash FROM f"""


@query(_vault_sql())
def pii_vault(spark, d):
    """Numbered tokens and hashes of the identifiers that were masked."""
    return text_rules.vault(scan(spark, d, "documents"), "doc_id", "text")


@query("""
SELECT l_orderkey, l_linenumber, TRY_CAST(nullif(regexp_extract(t, '(?:hr|pulse)[ :=]*([0-9]{2,3})', 1), '') AS DOUBLE) AS hr, TRY_CAST(nullif(regexp_extract(t, '(?:hb|hgb)[ :=]*([0-9]{1,2}(?:[.][0-9])?)', 1), '') AS DOUBLE) AS hb
FROM (SELECT *, 'pulse ' || CAST(CAST(l_quantity AS INTEGER) + 50 AS VARCHAR) || ' hb: ' || CAST(l_linenumber AS VARCHAR) || '.5' AS t FROM lineitem)""")
def extract_structured(spark, d):
    t = F.concat(F.lit("Pulse "), (F.col("l_quantity").cast("int") + 50).cast("string"), F.lit(" Hb: "), F.col("l_linenumber").cast("string"), F.lit(".5"))
    found = text_rules.measures(t)
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", found["hr"].alias("hr"), found["hb"].alias("hb"))


@query("""
SELECT page_id, count(*) AS rows, CAST(sum(length(x)) AS BIGINT) AS chars FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(unnest(string_split_regex(html, '</p>|<br>|</h1>|</li>')), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS x FROM pages) WHERE length(x) > 2 GROUP BY 1""")
def html_to_text_rows(spark, d):
    rows = scan(spark, d, "pages").select("page_id", F.explode(F.split("html", "</p>|<br>|</h1>|</li>")).alias("x"))
    rows = rows.withColumn("x", F.trim(F.regexp_replace(F.regexp_replace("x", "<[^>]*>", " "), "[ \\t\\r\\n]+", " "))).where(F.length("x") > 2)
    return rows.groupBy("page_id").agg(F.count("*").alias("rows"), F.sum(F.length("x")).cast("long").alias("chars"))


@query("""
SELECT doc_id, CASE WHEN b < 0.9 THEN 'train' WHEN b < 0.97 THEN 'validation' ELSE 'test' END AS part FROM (SELECT doc_id, CAST('0x' || substr(sha1(text), 1, 2) AS INTEGER) / 255 AS b FROM documents)""")
def hash_split(spark, d):
    return scan(spark, d, "documents").select("doc_id", text_rules.hash_split(F.col("text")).alias("part"))


@query("""
SELECT doc_id, CASE WHEN r < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'validation' END AS part FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)""")
def positional_split(spark, d):
    w = Window.partitionBy("source")
    t = scan(spark, d, "documents").select("doc_id", (F.row_number().over(w.orderBy("doc_id")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    return t.select("doc_id", F.when(F.col("r") < F.floor(F.col("n") * 0.9), "train").otherwise("validation").alias("part"))


@query("""SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM benchmark) WHERE c <> ''""")
def char_dictionary(spark, d):
    return scan(spark, d, "benchmark").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").distinct()


@query("""
SELECT conv_id, turn, '### Instruction:' || chr(10) || 'Correct the text.' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM conversations WHERE role = 'user'""")
def prompt_format(spark, d):
    return scan(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("### Instruction:\nCorrect the text.\n\n### Input:\n"), F.col("text"), F.lit("\n\n### Response:\n")).alias("prompt"))


@query("""
SELECT c_custkey, v AS style, CASE v WHEN 'tab' THEN concat_ws(chr(9), c_custkey::VARCHAR, c_name, c_mktsegment) WHEN 'pipe' THEN concat_ws(' | ', c_custkey::VARCHAR, c_name, c_mktsegment) ELSE concat_ws(' ', c_custkey::VARCHAR, c_name, c_mktsegment) END AS line
FROM customer CROSS JOIN (VALUES ('tab'), ('pipe'), ('compact')) t(v)""")
def format_variants(spark, d):
    cols = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")]
    styles = F.array(*[F.struct(F.lit(n).alias("style"), F.concat_ws(sep, *cols).alias("line")) for n, sep in (("tab", "\t"), ("pipe", " | "), ("compact", " "))])
    return scan(spark, d, "customer").select("c_custkey", F.explode(styles).alias("s")).select("c_custkey", "s.style", "s.line")


@query()
def noise_generator(spark, d):
    """The same noise each time: a hash of key and place decides."""
    return scan(spark, d, "conversations").select("conv_id", "turn", text_rules.noisy(F.col("text"), F.col("conv_id") * 1000 + F.col("turn"), 0.05, {"o": "0", "l": "1", "e": "c"}).alias("noisy"))


@query(f"""
SELECT CAST(least(floor(density * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(density), 6) AS confidence, round(avg(quality), 6) AS accuracy
FROM (SELECT doc_id, {_DENSITY} AS density FROM documents) JOIN labels USING (doc_id) WHERE density IS NOT NULL GROUP BY 1""")
def reliability_bins(spark, d):
    return learning.reliability(_scored(spark, d), "density", "quality").withColumns({"confidence": F.round("confidence", 6), "accuracy": F.round("accuracy", 6)})


def _scored(spark, d):
    docs = scan(spark, d, "documents").select("doc_id", "source", text_density(F.col("text")).alias("density"))
    return docs.join(scan(spark, d, "labels"), "doc_id")


@query(f"""
SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, avg(density) AS c, avg(quality) AS a
  FROM (SELECT doc_id, {_DENSITY} AS density FROM documents) JOIN labels USING (doc_id) WHERE density IS NOT NULL GROUP BY least(floor(density * 10), 9))""")
def calibration_error(spark, d):
    return learning.calibration_error(learning.reliability(_scored(spark, d), "density", "quality")).select(F.round("ece", 6).alias("ece"))


@query()
def platt_scaling(spark, d):
    fit = learning.platt(_scored(spark, d), "density", "quality")
    return spark.createDataFrame([fit or (None, None)], "slope double, intercept double")


@query()
def isotonic_fit(spark, d):
    return learning.isotonic(_scored(spark, d), "source", "density", "quality")


@query("""
WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, CAST(dim AS INTEGER) AS dim, count(*) AS n, round(avg(CAST(v AS DOUBLE)), 6) AS mean, round(CASE WHEN count(*) = 1 THEN 2.0 ELSE greatest(var_pop(CAST(v AS DOUBLE)), 0.1 / sqrt(count(*))) END, 6) AS variance FROM x GROUP BY 1, 2""")
def gaussian_landscape(spark, d):
    return learning.gaussian_landscape(scan(spark, d, "embeddings"), "label", "embedding").withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


@query("""
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
g AS (SELECT label, dim, count(*) AS n, avg(v) AS m, CASE WHEN count(*) = 1 THEN 2.0 ELSE greatest(var_pop(v), 0.1 / sqrt(count(*))) END AS s FROM x WHERE label IS NOT NULL GROUP BY 1, 2),
s AS (SELECT vec_id, g.label, round(-0.5 * sum((v - m) * (v - m) / (s + 1e-8)) + 0.5 * ln(max(n) + 1), 6) AS score, max(abs(v - m) / sqrt(s + 1e-8)) AS z FROM x JOIN g USING (dim) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)
SELECT vec_id, max(CASE WHEN r = 1 THEN label END) AS predicted, round(max(CASE WHEN r = 1 THEN score END), 3) AS score, round(max(CASE WHEN r = 1 THEN z END), 3) AS rejection,
  round(least(greatest((max(CASE WHEN r = 1 THEN score END) - max(CASE WHEN r = 2 THEN score END)) / nullif(max(score) - min(score), 0), 0), 1), 3) AS confidence FROM r GROUP BY 1""")
def gaussian_classifier(spark, d):
    e = scan(spark, d, "embeddings")
    found = learning.classify_landscape(e, "vec_id", "embedding", learning.gaussian_landscape(e, "label", "embedding"))
    return found.withColumns({c: F.round(c, 3) for c in ("score", "rejection", "confidence")})


@query("""
WITH c AS (SELECT label, list(m ORDER BY dim) AS m FROM (SELECT label, dim, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, arg_min(c.label, (round(list_sum(list_transform(range(1, 65), lambda i: abs(CAST(embedding[i] AS DOUBLE) - m[i]) * CASE WHEN i <= 8 THEN 5.0 WHEN i <= 16 THEN 2.0 ELSE 1.5 END)), 9), c.label)) AS nearest FROM embeddings CROSS JOIN c GROUP BY vec_id""")
def weighted_l1_nearest(spark, d):
    """The nearest class centre by weighted absolute differences."""
    e = scan(spark, d, "embeddings")
    centres = learning.gaussian_landscape(e, "label", "embedding").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("m"))
    d1 = F.round(learning.weighted_l1(F.col("embedding"), F.col("m"), [5.0] * 8 + [2.0] * 8 + [1.5] * 48), 9)
    return learning.against_labels(e.select("vec_id", "embedding"), centres).groupBy("vec_id").agg(F.min(F.struct(d1.alias("d"), "label"))["label"].alias("nearest"))


@query("""
SELECT event_type, round(ln(1 + count(*)) / ln(101), 6) AS frequency, round(0.3 * ln(1 + count(DISTINCT user_id)), 6) AS context FROM events GROUP BY 1""")
def learned_boosts(spark, d):
    e = scan(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    return e.select("event_type", F.round(learning.frequency_boost(F.col("n")), 6).alias("frequency"), F.round(learning.context_boost(F.col("u")), 6).alias("context"))


_MERGE = """CASE WHEN a.bed IS NOT NULL AND b.bed IS NOT NULL THEN a.bed = b.bed
  WHEN levenshtein(a.name, b.name) <= 1 THEN TRUE WHEN a.gender <> b.gender THEN FALSE WHEN abs(a.age - b.age) > 8 THEN FALSE WHEN abs(a.age - b.age) <= 2 AND a.dx = b.dx THEN TRUE ELSE levenshtein(a.name, b.name) <= 2 END"""


@query()
def fieldwise_accuracy(spark, d):
    """Predicted against true records of a page, matched one to one by score, and their share of right fields."""
    truth = scan(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("t"), "o_orderstatus", "o_orderpriority")
    seen = truth.select("page", (F.col("t") * 10).alias("p"), "o_orderstatus", F.when(F.col("t") % 7 == 0, "5-LOW").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    pairs = seen.alias("s").join(truth.alias("t"), "page")
    score = (F.col("s.o_orderstatus") == F.col("t.o_orderstatus")).cast("int") * 10 + (F.col("s.o_orderpriority") == F.col("t.o_orderpriority")).cast("int") * 5
    scored = pairs.select("page", "p", "t", score.alias("score"), (F.col("s.o_orderpriority") == F.col("t.o_orderpriority")).alias("right")).where("score >= 3")
    return records.one_to_one(scored, "page", "p", "t", "score").groupBy("page").agg(F.count("*").alias("matched"), F.count_if("right").alias("right"))


@query("""
SELECT conv_id, turn, md5(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))) AS key, len(list_filter(string_split(text, ','), lambda x: trim(x) <> '')) AS parts FROM conversations""")
def metric_keys(spark, d):
    return scan(spark, d, "conversations").select("conv_id", "turn", F.md5(metric_key(F.col("text"))).alias("key"), F.size(list_values(F.col("text"))).cast("long").alias("parts"))


@query("""SELECT c_custkey, c_mktsegment AS word, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS titled FROM customer WHERE length(c_mktsegment) > 1""")
def case_transfer(spark, d):
    return scan(spark, d, "customer").where(F.length("c_mktsegment") > 1).select("c_custkey", F.col("c_mktsegment").alias("word"), preserve_case(F.lit("Word"), F.col("c_mktsegment")).alias("titled"))


@query(f"""
SELECT lang, count(*) AS n, CAST(floor(1000 * avg({_DENSITY}) + 0.5) AS BIGINT) AS density FROM documents WHERE text <> '' GROUP BY 1""")
def text_density_by_language(spark, d):
    return scan(spark, d, "documents").where("text <> ''").groupBy("lang").agg(F.count("*").alias("n"), js_round(1000 * F.avg(text_density(F.col("text")))).alias("density"))
