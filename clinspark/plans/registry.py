"""Suggestions, cross-checks, corrections, layout and codes as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspark.operators import correction, layout, ordered, review, text_rules
from clinspark.sources import codecs
from clinspark.sources.store import recent, scan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TEXTS = ["on ventilator", "hip fracture, covid", "walking", "mrsa on nasal cannula", "sepsis", "nothing of note", "stemi with bipap", "uti"]
_PICK = f"({_TEXTS!r})[CAST(o_orderkey % 8 AS INTEGER) + 1]"


def _case(rules):
    body = " ".join(f"WHEN regexp_matches(t, '{text_rules.whole_words(r.pattern)}') THEN '{r.outcome}'" for r in sorted(rules, key=lambda r: -r.severity))
    return f"CASE {body} END"


_ACUITY = "greatest(0.0::DOUBLE, " + ", ".join(f"CASE WHEN regexp_matches(t, '{text_rules.whole_words(p)}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in review.ACUITY) + ")"


@query(f"""
WITH o AS (SELECT o_orderkey, {_PICK} AS t FROM orders), a AS (SELECT *, {_ACUITY} AS acuity FROM o)
SELECT o_orderkey, {_case(review.MOBILITY_RULES)} AS mobility, {_case(review.OXYGEN_RULES)} AS o2, {_case(review.ISOLATION_RULES)} AS iso, acuity,
       CASE WHEN acuity >= 0.8 THEN 'RED' WHEN acuity >= 0.5 THEN 'YELLOW' ELSE 'GREEN' END AS triage FROM a""")
def care_suggestions(spark, d):
    """Mobility, oxygen, isolation and acuity from a text; null means not assessed."""
    t = F.get(F.array(*[F.lit(x) for x in _TEXTS]), (F.col("o_orderkey") % 8).cast("int"))
    o = scan(spark, d, "orders").select("o_orderkey", t.alias("t"))
    s = lambda rules: review.suggest(F.col("t"), rules)["outcome"]
    o = o.select("o_orderkey", s(review.MOBILITY_RULES).alias("mobility"), s(review.OXYGEN_RULES).alias("o2"), s(review.ISOLATION_RULES).alias("iso"), review.acuity(F.col("t")).alias("acuity"))
    return o.withColumn("triage", review.acuity_triage(F.col("acuity")))


@query("""
WITH c AS (SELECT c_custkey, CAST(c_custkey % 140 AS INTEGER) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
  (['stemi', 'prostate', 'ovarian', 'ckd5', 'htn', 'dvt'])[CAST(c_custkey % 6 AS INTEGER) + 1] AS dx, (['metformin', 'insulin', 'heparin', 'none'])[CAST(c_custkey % 4 AS INTEGER) + 1] AS meds FROM customer)
SELECT c_custkey, list_filter([CASE WHEN age > 120 THEN 'AGE_IMPLAUSIBLE' END, CASE WHEN age < 18 AND dx = 'stemi' THEN 'UNUSUAL_FOR_AGE' END, CASE WHEN gender = 'M' AND dx = 'ovarian' THEN 'DX_NOT_FOR_MALE' END,
  CASE WHEN gender = 'F' AND dx = 'prostate' THEN 'DX_NOT_FOR_FEMALE' END, CASE WHEN meds = 'metformin' AND dx = 'ckd5' THEN 'METFORMIN_KIDNEY' END, CASE WHEN meds = 'insulin' THEN 'INSULIN_WITHOUT_DIABETES' END,
  CASE WHEN meds = 'heparin' AND dx NOT IN ('dvt', 'stemi') THEN 'ANTICOAGULANT_WITHOUT_CAUSE' END], lambda x: x IS NOT NULL) AS codes FROM c""")
def cross_field_checks(spark, d):
    k = F.col("c_custkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    w = review.cross_checks((k % 140).cast("int"), F.when(k % 2 == 0, "M").otherwise("F"), pick(["stemi", "prostate", "ovarian", "ckd5", "htn", "dvt"]), pick(["metformin", "insulin", "heparin", "none"]))
    return scan(spark, d, "customer").select("c_custkey", F.transform(w, lambda x: x["code"]).alias("codes"))


@query("""
SELECT o_orderkey, CASE WHEN c < 0.52 OR n = 0 THEN 'VERIFY' WHEN c < 0.8 OR n < 2 THEN 'REVIEW' ELSE 'READY' END AS level FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS c, o_orderkey % 4 AS n FROM orders)""")
def review_levels(spark, d):
    o = F.col("o_orderkey")
    n, c = o % 4, (o % 100) / F.lit(100.0)
    reasons = F.array_compact(F.array(F.when(n < 2, "Partial identifiers")))
    none = F.array().cast("array<struct<field:string,severity:string,code:string>>")
    return scan(spark, d, "orders").select("o_orderkey", review.review_level(n, c, reasons, none).alias("level"))


@query("""
WITH h AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS kind, round(l_quantity / 50, 2) AS score, CAST(l_partkey % 5 + 1 AS BIGINT) AS n FROM lineitem),
r AS (SELECT *, row_number() OVER w AS r, first_value(score) OVER w AS b, first_value(n) OVER w AS bn FROM h WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, n DESC, kind)),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN kind IN ('1', '2') AND b - score <= 0.03 AND n >= greatest(1, bn - 1) THEN 0 ELSE 1 END, r) AS p FROM r)
SELECT l_orderkey, kind, score, n FROM p WHERE p = 1""")
def best_hypothesis(spark, d):
    h = scan(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("kind"), F.round(F.col("l_quantity") / 50, 2).alias("score"), (F.col("l_partkey") % 5 + 1).alias("n"))
    return review.best_hypothesis(h, "l_orderkey", "kind", "score", "n", ["1", "2"])


@query("""
WITH h AS (SELECT l_orderkey, round(l_quantity / 50, 2) AS s, max(round(l_quantity / 50, 2)) OVER (PARTITION BY l_orderkey) AS b FROM lineitem)
SELECT l_orderkey, count(*) AS passes, round(least(max(s) + 0.02 * (count(*) - 1), 1.0), 6) AS score FROM h WHERE b - s <= 0.12 AND (s >= 0.64 OR s = b) GROUP BY 1""")
def fuse_passes(spark, d):
    h = scan(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_quantity") / 50, 2).alias("s"))
    return review.fuse_passes(h, "l_orderkey", "s").withColumn("score", F.round("score", 6))


@query("""
SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) WHEN 2 THEN 'VERIFY' WHEN 1 THEN 'REVIEW' ELSE 'READY' END AS level FROM orders GROUP BY 1""")
def consolidated_levels(spark, d):
    o = scan(spark, d, "orders").withColumn("level", F.when(F.col("o_orderstatus") == "P", "VERIFY").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("READY"))
    return review.consolidated(o, ["o_custkey"], "level")


@query("""
SELECT o_orderkey, replace(replace('Arnodarone ' || o_orderkey || 'mg dally', 'Arnodarone', 'Amiodarone'), 'dally', 'daily') AS corrected FROM orders""")
def text_correction(spark, d):
    t = F.concat(F.lit("Arnodarone "), F.col("o_orderkey").cast("string"), F.lit("mg dally"))
    return scan(spark, d, "orders").select("o_orderkey", correction.correct_text(t).alias("corrected"))


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS term FROM part), q AS (SELECT DISTINCT term || 'x' AS seen FROM w UNION SELECT term FROM w),
m AS (SELECT seen, term, levenshtein(seen, term) AS dist FROM q JOIN w ON abs(length(seen) - length(term)) <= 2 WHERE levenshtein(seen, term) <= 2 AND (seen NOT IN (SELECT term FROM w) OR seen = term)),
s AS (SELECT *, greatest(0.0, 1 - dist / greatest(length(term), 3)) * least(length(term), length(seen)) / greatest(length(term), length(seen)) AS score FROM m)
SELECT seen, term, CAST(dist AS INTEGER) AS distance, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seen ORDER BY round(score, 9) DESC, term) AS r FROM s) WHERE r <= 5""")
def top_candidates(spark, d):
    words = scan(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term")).distinct()
    seen = words.select(F.explode(F.array(F.col("term"), F.concat("term", F.lit("x")))).alias("seen")).distinct()
    found = correction.top_candidates(seen, ["seen"], "seen", words.withColumn("boost", F.lit(0.0)), "term", "boost")
    return found.select("seen", "term", "distance", F.round("score", 6).alias("score"), "rank")


@query("""
SELECT p_partkey, list_sort(list(DISTINCT o)) AS outcomes FROM part JOIN (VALUES ('an', 'A'), ('er', 'B'), ('st', 'C')) t(k, o) ON contains(lower(p_name || p_type), k) GROUP BY 1""")
def contains_inference(spark, d):
    pairs = spark.createDataFrame([("AN", "A"), ("er", "B"), ("st", "C")], "needle string, outcome string")
    return correction.infer_by_contains(scan(spark, d, "part").withColumn("t", F.concat("p_name", "p_type")), "p_partkey", "t", pairs, "needle", "outcome")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '1') AND c_custkey NOT IN (1, 10) ORDER BY c_custkey LIMIT 8""")
def drug_suggestions(spark, d):
    return correction.suggestions(scan(spark, d, "customer"), ["c_name"], "1", "c_custkey", [1, 10]).select("c_custkey", "c_name")


@query("""SELECT event_id, ts, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100""")
def recent_transactions(spark, d):
    return recent(scan(spark, d, "events"), "ts", "event_id", 100, hash_column="event_type", hash_value="click").select("event_id", "ts", "user_id")


@query()
def column_layout(spark, d):
    """Columns of plain text and their roles."""
    words = text_rules.plain_text_words(scan(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", "text")
    words = words.withColumn("entity", text_rules.classify_token(F.col("text"))).withColumn("confidence", F.lit(0.9))
    return layout.column_roles(layout.column_bands(words))


@query()
def relabelled_rows(spark, d):
    """Rows of words with unknown entities named by their neighbours, and what each row is worth as a record."""
    words = text_rules.plain_text_words(scan(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", "text")
    words = words.withColumn("entity", text_rules.classify_token(F.col("text"))).withColumn("confidence", F.lit(0.5))
    return layout.identity_scores(layout.relabel_rows(ordered.row_bands(words)))


@query("""
WITH t AS (SELECT p_partkey AS doc_id, p_name || ' | ' || p_brand AS line, list_filter(string_split_regex(p_name || ' | ' || p_brand, '[|\\s]+'), lambda x: x <> '') AS ws FROM part),
p AS (SELECT doc_id, line, ws, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS part FROM t)
SELECT doc_id, CAST(part AS INTEGER) AS part, text, round(least(coalesce(list_sum(list_transform(ws[1:part], lambda w: length(w) + 1)), 0) / length(line), 1.0) * 300.0, 6) AS x, round(length(text) / length(line) * 300.0, 6) AS w FROM p""")
def split_words(spark, d):
    """A box for each word of a line, as wide as its share."""
    lines = scan(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" | ", "p_name", "p_brand").alias("text"), F.lit(0.0).alias("x"), F.lit(10.0).alias("y"), F.lit(300.0).alias("w"), F.lit(12.0).alias("h"))
    return layout.split_detections(lines).select("doc_id", "part", "text", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@query("""
WITH g AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS gap FROM (SELECT DISTINCT user_id, value FROM events)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap > 0)
SELECT user_id, round(least(greatest(gap * 2.5, 0.5), 3.0), 6) AS eps FROM r WHERE i = CAST(floor(n / 2) AS BIGINT) + 1""")
def gap_epsilon(spark, d):
    return layout.gap_epsilon(scan(spark, d, "events"), "user_id", "value", 2.5, 0.5, 3.0).withColumn("eps", F.round("eps", 6))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey < 100 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS number FROM customer)
SELECT c_custkey, 0 AS place, '5A' AS tag, number AS value FROM c UNION ALL SELECT c_custkey, 1, '5F1F', 'A' FROM c""")
def tlv_decoding(spark, d):
    """Elements of binary card data."""
    digits = F.col("c_custkey").cast("string")
    number = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    size = F.unhex(F.lpad(F.hex(F.length(number)), 2, "0"))
    raw = scan(spark, d, "customer").select("c_custkey", F.concat(F.unhex(F.lit("5A")), size, F.encode(number, "UTF-8"), F.unhex(F.lit("5F1F0141"))).alias("raw"))
    return codecs.tlv_elements(raw, "c_custkey", "raw").select("c_custkey", "place", "tag", F.decode("value", "UTF-8").alias("value"))


@query("""
SELECT page, bad = 0 AS medical_grade, bad FROM (SELECT o_custkey AS page, (avg(o_totalprice) > 150000)::INT + (count(*) < 10)::INT AS bad FROM orders GROUP BY 1)""")
def grade_verdict(spark, d):
    m = scan(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.avg("o_totalprice").alias("cer"), F.count("*").alias("n"))
    v = review.verdict({"cer": F.col("cer"), "n": F.col("n")}, {"cer": ("max", 150000.0), "n": ("min", 10)}, F.lit(False))
    return m.select("page", v["medical_grade"].alias("medical_grade"), F.size(v["failed"]).alias("bad"))
