"""Clinical rules over text and values as queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from clinspark.functions.scalar import key_seed
from clinspark.operators import clinical_text as X
from clinspark.operators import entities, text_rules
from clinspark.sources import codecs
from clinspark.sources.store import scan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TERMS = [
    "STEMI", "nstemi", "septic shock", "Sepsis", "DKA", "dm2", "htn", "malignant htn", "HTN crisis", "UTI", "status epilepticus", "seizure", "PE", "peptic ulcer", "AKI", "ckd3", "CKD5", "cellulitis",
    "COPD with exacerbation", "aecopd", "upper GI bleed", "postpartum bleed", "resp failure", "type 2 RF", "overdose", "fall", "cholangitis", "acute pancreatitis", "decompensated HF", "SAH", "observation",
]
_N = len(_TERMS)
_PICKED = f"({_TERMS!r})[CAST(o_orderkey % {_N} AS INTEGER) + 1] || ', ' || ({_TERMS!r})[CAST(o_orderkey // 7 % {_N} AS INTEGER) + 1] || ' / ' || ({_TERMS!r})[CAST(o_orderkey // 50 % {_N} AS INTEGER) + 1]"


def _rule_sql(rule: X.TriageRule) -> str:
    """A rule without looking ahead: what follows the last place that forbids it must match."""
    stops = re.findall(r"\(\?!\.\*(.*?)\)", rule.pattern)
    body = re.sub(r"\(\?!.*?\)", "", rule.pattern)
    text = f"regexp_replace(t, '(?i)^.*(?:{'|'.join(stops)})', '')" if stops else "t"
    return f"CASE WHEN regexp_matches({text}, '(?i){body}') THEN {{'s': {-X.SEVERITY[rule.outcome]}, 'rule': '{rule.code}', 'triage': '{rule.outcome}', 'confidence': {rule.confidence}::DOUBLE}} END"


_HITS = ", ".join(_rule_sql(r) for r in X.TRIAGE)
_PLACE = "CASE rule " + " ".join(f"WHEN '{r.code}' THEN {i}" for i, r in enumerate(X.TRIAGE)) + " END"


@query(f"""
WITH o AS (SELECT o_orderkey, {_PICKED} AS t FROM orders), h AS (SELECT o_orderkey, unnest([{_HITS}]) AS h FROM o),
r AS (SELECT o_orderkey, h.s AS s, h.rule AS rule, h.triage AS triage, h.confidence AS confidence FROM h WHERE h IS NOT NULL),
a AS (SELECT o_orderkey, list(rule ORDER BY s, {_PLACE}) AS rules, list(triage ORDER BY s, {_PLACE}) AS ts, list(confidence ORDER BY s, {_PLACE}) AS cs FROM r GROUP BY 1)
SELECT o_orderkey, ts[1] AS triage, coalesce(cs[1], 0.0::DOUBLE) AS confidence, coalesce(rules, []) AS rules, coalesce(len(list_distinct(ts)) > 1, FALSE) AS conflict FROM orders LEFT JOIN a USING (o_orderkey)""")
def triage_suggestions(spark, d):
    """What three diagnoses suggest, with all rules that speak."""
    k, terms = F.col("o_orderkey"), F.array(*[F.lit(t) for t in _TERMS])
    pick = lambda c: F.get(terms, (F.floor(c) % _N).cast("int"))
    dx = F.concat(pick(k), F.lit(", "), pick(k / 7), F.lit(" / "), pick(k / 50))
    return X.read_once(scan(spark, d, "orders").select("o_orderkey", dx.alias("dx")), "dx", X.suggest_triage, "s").select("o_orderkey", "s.triage", "s.confidence", F.transform("s.rules", lambda r: r["rule"]).alias("rules"), "s.conflict")


_Q, _L = "CAST(l_quantity AS INTEGER)", "CAST(l_linenumber AS INTEGER)"
_CODES, _DIETS, _LINES = ["full code", "DNR", "seen"], ["NPO", "renal diet", "eats"], ["Foley in, PICC ok", "ETT", "none", "chest tube"]


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, {_Q} AS q, {_L} AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, (90 + q)::DOUBLE AS sbp, (50 + n)::DOUBLE AS dbp, (60 + q)::DOUBLE AS hr, (10 + n)::DOUBLE AS rr, ('37.' || n)::DOUBLE AS temp, (49 + q)::DOUBLE AS spo2, (8 + n)::DOUBLE AS gcs,
  (n || '.5')::DOUBLE AS wbc, ((7 + n) || '.' || n)::DOUBLE AS hgb, (100 + q)::DOUBLE AS plt, (120 + q)::DOUBLE AS na, (n || '.2')::DOUBLE AS k, (n || '.1')::DOUBLE AS cr, (90 + q)::DOUBLE AS glucose,
  (n || '.4')::DOUBLE AS lactate, (n || '.3')::DOUBLE AS inr, ('0.0' || n)::DOUBLE AS trop, q::DOUBLE AS crp, ('7.' || n)::DOUBLE AS ph,
  CASE n % 3 WHEN 0 THEN 'FULL' WHEN 1 THEN 'DNR' END AS code, CASE q % 3 WHEN 0 THEN 'NPO' WHEN 1 THEN 'RENAL' END AS diet,
  CASE q % 4 WHEN 0 THEN ['PICC', 'Foley'] WHEN 1 THEN ['ETT'] WHEN 2 THEN []::VARCHAR[] ELSE ['Chest Tube'] END AS lines FROM x""")
def clinical_extraction(spark, d):
    """Every measure, code status, diet and line of a note."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")
    of = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i % len(xs))
    parts = [
        "BP ", 90 + q, "/", 50 + n, ", pulse ", 60 + q, ", RR: ", 10 + n, ", temp 37.", n, ", SpO2 ", 49 + q, "%, GCS=", 8 + n, "; WBC ", n, ".5 Hb: ", 7 + n, ".", n, " plt ", 100 + q, " Na ", 120 + q, " K ", n,
        ".2 Cr ", n, ".1 glucose ", 90 + q, " lactate ", n, ".4 INR ", n, ".3 trop 0.0", n, " CRP ", q, " pH 7.", n, ". ", of(_CODES, n), "; ", of(_DIETS, q), "; ", of(_LINES, q),
    ]
    note = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return X.read_once(scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", note.alias("note")), "note", X.extract, "x").select("l_orderkey", "l_linenumber", "x.*")


_KINDS = [*X.VITALS, *X.LABS, "other"]
_RANGES = ", ".join([f"('{n}', TRUE, {a}, {b}, {c}, {e}, NULL, NULL)" for n, (a, b, c, e) in X.VITALS.items()] + [f"('{n}', FALSE, {r.least}, {r.most}, {r.critical_low}, {r.critical_high}, {r.low}, {r.high})" for n, r in X.LABS.items()])


@query(f"""
WITH r AS (SELECT * FROM (VALUES {_RANGES}) t(kind, vital, least, most, cl, ch, low, high)),
o AS (SELECT o_orderkey, ({_KINDS!r})[CAST(o_orderkey % {len(_KINDS)} AS INTEGER) + 1] AS kind, (o_orderkey // 3 % 2000) / 8.0::DOUBLE AS v FROM orders)
SELECT o_orderkey, kind, CASE WHEN least IS NULL THEN 'unknown' WHEN v < least OR v > most THEN 'implausible' WHEN v < cl THEN 'critical_low' WHEN (vital AND v >= ch) OR (NOT vital AND v > ch) THEN 'critical_high'
  WHEN v < low THEN 'low' WHEN v > high THEN 'high' ELSE 'normal' END AS status FROM o LEFT JOIN r USING (kind)""")
def value_statuses(spark, d):
    """Vital signs and laboratory values against their limits."""
    k = F.col("o_orderkey")
    o = scan(spark, d, "orders").select("o_orderkey", F.get(F.array(*[F.lit(x) for x in _KINDS]), (k % len(_KINDS)).cast("int")).alias("kind"), ((F.floor(k / 3) % 2000) / 8.0).alias("v"))
    kind, v = F.col("kind"), F.col("v")
    return o.select("o_orderkey", "kind", F.when(kind.isin(list(X.VITALS)), X.vital_status(kind, v)).otherwise(X.lab_value_status(kind, v)).alias("status"))


_DX = ["newborn jaundice", "Croup", "STEMI", "old MI", "prostate", "croupier", "mild fever"]


@query(f"""
WITH c AS (SELECT c_custkey, CAST(c_custkey % 90 AS INTEGER) AS age, c_custkey % 7 AS dx, c_custkey % 300 AS units, c_custkey * 3 AS mg FROM customer)
SELECT c_custkey, NOT ((age > 18 AND dx IN (0, 1)) OR (age < 5 AND dx IN (2, 3, 4))) AS fits,
  CASE WHEN c_custkey % 3 = 0 AND mg > 5000 THEN 'IMPLAUSIBLE_DOSE' WHEN c_custkey % 3 = 1 AND units > 200 THEN 'IMPLAUSIBLE_DOSE' END AS dose,
  units > 3 * 50 OR units < 0.5 * 8 AS beyond_extremes, units > 5 * 17 OR units < 0.1 * 12 AS beyond_normal FROM c""")
def plausibility_flags(spark, d):
    """Ages against diagnoses, doses, and values far beyond their limits by both rules."""
    k = F.col("c_custkey")
    dose = F.when(k % 3 == 0, F.concat((k * 3).cast("string"), F.lit(" mg"))).when(k % 3 == 1, F.concat((k % 300).cast("string"), F.lit(" units"))).otherwise(F.concat(F.lit("about "), (k * 30).cast("string"), F.lit("mg")))
    units = (k % 300).cast("double")
    return scan(spark, d, "customer").select(
        "c_custkey", X.age_fits_diagnosis((k % 90).cast("int"), F.get(F.array(*[F.lit(x) for x in _DX]), (k % 7).cast("int"))).alias("fits"),
        X.dose_flag(F.when(k % 3 == 1, "Insulin glargine").otherwise("aspirin"), dose).alias("dose"), X.far_beyond(units, 8, 50).alias("beyond_extremes"), X.far_beyond(units, 12, 17, 5.0, 0.1).alias("beyond_normal"),
    )


#: Clues of the invented languages of the tables.
_CLUES = {"english": ["the ", "tion", "and "], "german": ["sch", "ung", "der "], "french": ["eux", "aient", "é"], "spanish": ["ción", "ñ", "que"]}
_COUNTS = {c: " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) for c, words in _CLUES.items()}


@query(f"""
WITH n AS (SELECT doc_id, {", ".join(f"{e} AS {c}" for c, e in _COUNTS.items())} FROM documents),
b AS (SELECT *, greatest({", ".join(_CLUES)}) AS best FROM n)
SELECT doc_id, coalesce(CASE WHEN best > 0 THEN CASE {" ".join(f"WHEN {c} = best THEN '{c}'" for c in _CLUES)} END END, 'default') AS context,
  CASE CASE WHEN best > 0 THEN CASE {" ".join(f"WHEN {c} = best THEN '{c}'" for c in _CLUES)} END END WHEN 'german' THEN 'Multiple Sklerose' WHEN 'french' THEN 'sclérose en plaques' ELSE 'multiple sclerosis' END AS sense FROM b""")
def context_senses(spark, d):
    """The context with most clues in a text, and what a term means there."""
    senses = {"MS": {"german": "Multiple Sklerose", "french": "sclérose en plaques", "default": "multiple sclerosis"}}
    return scan(spark, d, "documents").select("doc_id", X.context_of(F.col("text"), _CLUES).alias("context"), X.sense_of("ms", F.col("text"), _CLUES, senses).alias("sense"))


def _digit(c: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, length({c}) + 1), lambda i: greatest(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', {c}[i]) - 1, 0) * CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END)) % 10 AS VARCHAR)"


@query(f"""
WITH o AS (SELECT o_orderkey, rpad('K' || o_orderkey, 9, '<') AS n, strftime(o_orderdate, '%y%m%d') AS b, strftime(o_orderdate + INTERVAL 3 DAY, '%y%m%d') AS e FROM orders)
SELECT o_orderkey, n || {_digit("n")} || b || {_digit("b")} || e || {_digit("e")} AS seed FROM o""")
def key_seeds(spark, d):
    """Seeds of access keys from document numbers and dates."""
    two = lambda c: F.date_format(c, "yyMMdd")
    return scan(spark, d, "orders").select("o_orderkey", key_seed(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")), two("o_orderdate"), two(F.date_add(F.to_date("o_orderdate"), 3))).alias("seed"))


@query("""
WITH c AS (SELECT c_custkey AS k, '2' || lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS civil FROM customer)
SELECT k AS c_custkey, CASE WHEN k % 3 <> 0 THEN civil END AS civil_id, CASE WHEN k % 4 = 0 THEN 'Anna Maria Schmidt' WHEN k % 5 = 0 THEN 'محمد علي' END AS name, CASE WHEN k % 5 = 0 THEN 'محمد علي' END AS name_arabic,
  CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender, CASE WHEN k % 2 = 0 THEN 'Kuwaiti' END AS nationality FROM c""")
def card_identities(spark, d):
    """Who a card belongs to, from its texts in any order."""
    k = F.col("c_custkey")
    civil = F.concat(F.lit("2"), F.lpad(k.cast("string"), 11, "0"))
    texts = F.array(
        F.when(k % 3 != 0, F.concat(F.lit("No "), civil, F.lit("."))).otherwise(F.concat(F.lit("X"), civil)), F.when(k % 4 == 0, "Anna Maria Schmidt").otherwise("anna maria"), F.when(k % 5 == 0, " محمد   علي ").otherwise(None),
        F.when(k % 3 == 0, "Sex: female").when(k % 3 == 1, "MALE").otherwise("males"), F.when(k % 2 == 0, "kuwaiti").otherwise(""),
    )
    return scan(spark, d, "customer").select("c_custkey", X.identity_of(texts).alias("x")).select("c_custkey", "x.*")


@query("""
WITH s AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS label, l_linenumber, l_quantity + CASE WHEN abs(l_linenumber % 3 - l_orderkey % 3) < 0.5 THEN 2.0 ELSE 0 END + CASE WHEN l_discount < 0.075 THEN 1.0 ELSE 0 END + CASE WHEN l_tax < 0.045 THEN 0.5 ELSE 0 END AS score FROM lineitem)
SELECT l_orderkey, list(label ORDER BY score DESC, l_linenumber) AS labels FROM s GROUP BY 1""")
def reranked_candidates(spark, d):
    """Candidates by score and how well their features fit the place."""
    n = F.col("l_linenumber").cast("int")
    one = F.struct(n.alias("n"), n.cast("string").alias("label"), F.col("l_quantity").cast("double").alias("score"), (n % 3).cast("double").alias("holes"), F.col("l_discount").cast("double").alias("ratio"), F.col("l_tax").cast("double").alias("symmetry"))
    lines = scan(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("c"))
    expected = F.struct((F.col("l_orderkey") % 3).cast("double").alias("holes"), F.lit(-0.075).alias("ratio"), F.lit(-0.055).alias("symmetry"))
    return lines.select("l_orderkey", F.transform(X.rerank(F.col("c"), expected), lambda x: x["label"]).alias("labels"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 12 AS c FROM orders)
SELECT k AS o_orderkey, CASE c WHEN 0 THEN 'BED' WHEN 1 THEN CASE WHEN k % 140 BETWEEN 1 AND 129 THEN 'AGE_GENDER' ELSE 'UNKNOWN' END WHEN 2 THEN 'CIVIL_ID' WHEN 3 THEN 'WARD' WHEN 4 THEN 'ASSIGNED_DOCTOR' WHEN 5 THEN 'AGE'
  WHEN 6 THEN 'UNKNOWN' WHEN 7 THEN 'NAME' WHEN 8 THEN 'MEDICATION' WHEN 9 THEN 'BED' WHEN 10 THEN CASE WHEN k >= 1000 THEN 'CIVIL_ID' ELSE 'UNKNOWN' END ELSE 'BLOOD_TYPE' END AS entity FROM o""")
def token_entities(spark, d):
    """What kind of entry each of many tokens is."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    tokens = [
        F.concat(F.lit("E-M-"), s(k % 90)), F.concat(s(k % 140), F.lit("/F")), F.concat(F.lit("2"), F.lpad(s(k), 11, "0")), F.concat(F.lit("Ward "), s(k % 30)), F.lit("Dr. Weber"), s(k % 100),
        F.split("o_orderpriority", "-")[1], F.initcap(F.lit("amina")), F.concat(F.lit("amox"), F.lit("icillin")), F.concat(F.lit("room "), s(k % 50), F.lit("A")), F.concat(F.lit("MRN "), s(k)), F.get(F.array(F.lit("AB+"), F.lit("O-"), F.lit("a+")), (k % 3).cast("int")),
    ]
    return scan(spark, d, "orders").select("o_orderkey", text_rules.classify_token(F.get(F.array(*tokens), (k % 12).cast("int"))).alias("entity"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ['DG1', 'DG11'] ELSE []::VARCHAR[] END AS groups, CASE WHEN c_custkey % 4 = 1 THEN 'P<' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS mrz,
  CASE WHEN c_custkey % 4 = 2 THEN 'jpeg' END AS format, CASE WHEN c_custkey % 4 = 2 THEN 7 END AS picture_bytes, CASE WHEN c_custkey % 4 = 3 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS personal_number,
  CASE WHEN c_custkey % 4 = 3 THEN 'city' END AS birthplace FROM customer""")
def card_contents(spark, d):
    """Lists, lines, pictures and details in the files of cards."""
    k = F.col("c_custkey")
    number = F.hex(F.lpad(k.cast("string"), 9, "0"))
    files = F.array(
        F.lit("600C5F0104303130375C03616B01"), F.concat(F.lit("610E5F1F0B503C"), number), F.lit("7508AAFFD8FF0001FFD9BB"),
        F.concat(F.lit("6B135F1009"), number, F.lit("5F110463697479")),
    )
    raw = scan(spark, d, "customer").select("c_custkey", F.unhex(F.get(files, (k % 4).cast("int"))).alias("raw"))
    out = codecs.card_files(raw, "c_custkey", "raw")
    return out.select("c_custkey", "groups", "mrz", "format", F.length("picture").alias("picture_bytes"), "personal_number", "birthplace")


def sheet_tokens(spark, d):
    """Tokens as sheets hold them: words of conversations, and cells written from the columns of customers."""
    k, bal = F.col("c_custkey"), F.floor(F.abs("c_acctbal"))
    s = lambda c: c.cast("string")
    deal = lambda *words: F.get(F.array(*[F.lit(w) for w in words]), (F.col("c_nationkey") % len(words)).cast("int"))
    cells = [
        F.concat(s(bal % 140), F.lit("/"), F.when(k % 2 == 0, "M").otherwise("f")), F.concat(F.when(k % 2 == 0, "F ").otherwise("m"), s(bal % 135)), s(bal % 130), F.concat(s(bal % 110), F.lit(" yrs old")),
        F.concat(F.lit("2"), F.lpad(s(k), 11, "0")), F.concat(F.lit("3-"), F.lpad(s(bal), 11, "O")), F.concat(F.lit("MRN: "), s(bal * 1000 + k % 1000)), F.concat(F.lit("Ward #"), s(k % 120)), F.concat(F.lit("O2 "), s(k % 12), F.lit("L")),
        F.concat(deal("AB", "A", "o", "B", "C"), F.when(k % 3 == 0, " pos").when(k % 3 == 1, "-").otherwise("")), F.concat(deal("day ", "d", "q", "obs q"), s(k % 40), F.when(k % 2 == 0, "h").otherwise("")),
        F.concat(deal("icu", "HDU", "red", "Yellow", "GREEN", "nkda", "DNR", "contact", "RA", "w/c"), F.when(k % 5 == 0, "n").otherwise("")), F.concat(deal("bipap", "nasal cannula", "vented", "Airborne", "ambulant", "stretcher", "bed bound"), F.lit(" "), s(k % 9)),
        F.concat_ws(" ", deal("allergic to", "Comfort", "to icu", "for", "ER", "female", "male"), deal("ct", "discharge", "penicillin")), deal("M", "f", "male", "Female", "NPO", "follow-up", "pcn", "NFR", "full code", "transferred"),
    ]
    written = scan(spark, d, "customer").select(F.explode(F.array(*cells)).alias("token"))
    said = scan(spark, d, "conversations").select(F.explode(F.split("text", "[ \\n]+")).alias("token"))
    return written.union(said).where("trim(token) <> ''").distinct()


def _kind_sql(kind):
    tests = " ".join(f"WHEN regexp_matches(t, '(?is)^{p}') THEN {c}" for p, c, _ in entities.PATTERNS[kind])
    return f"SELECT token, '{kind}' AS kind, CAST(CASE {tests} END AS DOUBLE) AS confidence FROM w"


def _deal_sql(*words):
    return f"({list(words)!r})[CAST(c_nationkey % {len(words)} AS INTEGER) + 1]"


_TOKENS_SQL = f"""
SELECT DISTINCT token FROM (SELECT unnest([
  bal % 140 || '/' || CASE WHEN k % 2 = 0 THEN 'M' ELSE 'f' END, CASE WHEN k % 2 = 0 THEN 'F ' ELSE 'm' END || bal % 135, CAST(bal % 130 AS VARCHAR), bal % 110 || ' yrs old', '2' || lpad(CAST(k AS VARCHAR), 11, '0'), '3-' || lpad(CAST(bal AS VARCHAR), 11, 'O'),
  'MRN: ' || (bal * 1000 + k % 1000), 'Ward #' || k % 120, 'O2 ' || k % 12 || 'L', {_deal_sql("AB", "A", "o", "B", "C")} || CASE k % 3 WHEN 0 THEN ' pos' WHEN 1 THEN '-' ELSE '' END, {_deal_sql("day ", "d", "q", "obs q")} || k % 40 || CASE WHEN k % 2 = 0 THEN 'h' ELSE '' END,
  {_deal_sql("icu", "HDU", "red", "Yellow", "GREEN", "nkda", "DNR", "contact", "RA", "w/c")} || CASE WHEN k % 5 = 0 THEN 'n' ELSE '' END, {_deal_sql("bipap", "nasal cannula", "vented", "Airborne", "ambulant", "stretcher", "bed bound")} || ' ' || k % 9,
  {_deal_sql("allergic to", "Comfort", "to icu", "for", "ER", "female", "male")} || ' ' || {_deal_sql("ct", "discharge", "penicillin")}, {_deal_sql("M", "f", "male", "Female", "NPO", "follow-up", "pcn", "NFR", "full code", "transferred")}]) AS token
  FROM (SELECT c_custkey AS k, c_nationkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS bal FROM customer)
  UNION ALL SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) FROM conversations) WHERE trim(token) <> ''"""


@query(f"""
WITH w AS (SELECT token, trim(token) AS t FROM ({_TOKENS_SQL})),
b AS (SELECT token, t, upper(regexp_replace(t, '\\s+', '', 'g')) AS blood, translate(regexp_replace(t, '[\\s-]', '', 'g'), 'OoIl|', '00111') AS civil, regexp_replace(upper(t), '[^A-Z0-9]', '', 'g') AS key FROM w),
s AS ({" UNION ALL ".join(_kind_sql(x) for x in ("WARD", "O2", "ISOLATION", "MOBILITY", "STATUS", "SHEET_STATUS", "ALLERGY", "GENDER"))}
  UNION ALL SELECT token, 'AGE_GENDER', CASE WHEN TRY_CAST(regexp_extract(t, '^(\\d{{1,3}})\\s*[/\\\\,\\- ]?\\s*([MFmf])$', 1) AS INTEGER) BETWEEN 1 AND 129 OR TRY_CAST(regexp_extract(t, '^([MFmf])\\s*[/\\\\,\\- ]?\\s*(\\d{{1,3}})$', 2) AS INTEGER) BETWEEN 1 AND 129 THEN 0.95::DOUBLE END FROM w
  UNION ALL SELECT token, 'AGE', CAST(CASE WHEN regexp_matches(t, '^\\d{{1,3}}$') THEN CASE WHEN CAST(t AS INTEGER) BETWEEN 18 AND 100 THEN 0.5 END WHEN regexp_matches(t, '(?i)^\\d{{1,3}}\\s*(?:y(?:rs?|ears?)?(?:\\s*old)?|سنة)$') THEN 0.9 END AS DOUBLE) FROM w
  UNION ALL SELECT token, 'CIVIL_ID', CAST(CASE WHEN regexp_matches(civil, '^[23]\\d{{11}}$') THEN 0.97 WHEN regexp_matches(t, '^(?:MRN|mrn|ID|id)[:\\s#]*\\d{{6,10}}$') THEN 0.85 END AS DOUBLE) FROM b
  UNION ALL SELECT token, 'BLOOD_TYPE', CAST(CASE WHEN regexp_matches(blood, '^(A|B|AB|O)[+-]$') THEN 0.92 WHEN regexp_matches(blood, '^(A|B|AB|O)$') THEN 0.6 WHEN regexp_matches(blood, '^(A|B|AB|O)(POS|NEG)') THEN 0.9 END AS DOUBLE) FROM b
  UNION ALL SELECT token, 'TRIAGE', CASE WHEN upper(t) IN ('RED', 'YELLOW', 'GREEN') THEN 0.98::DOUBLE WHEN levenshtein(key, 'RED') <= 1 THEN 0.72::DOUBLE + (1::DOUBLE - levenshtein(key, 'RED') / greatest(length(key), 3)) * 0.22::DOUBLE
    WHEN levenshtein(key, 'YELLOW') <= 1 THEN 0.72::DOUBLE + (1::DOUBLE - levenshtein(key, 'YELLOW') / greatest(length(key), 6)) * 0.22::DOUBLE WHEN levenshtein(key, 'GREEN') <= 1 THEN 0.72::DOUBLE + (1::DOUBLE - levenshtein(key, 'GREEN') / greatest(length(key), 5)) * 0.22::DOUBLE END FROM b)
SELECT token, kind, round(confidence, 9) AS confidence FROM s WHERE confidence > 0.3""")
def entity_confidences(spark, d):
    """How sure each scorer by pattern is of each different token."""
    kinds = ["WARD", "O2", "ISOLATION", "MOBILITY", "STATUS", "SHEET_STATUS", "ALLERGY", "GENDER", "AGE_GENDER", "AGE", "CIVIL_ID", "BLOOD_TYPE", "TRIAGE"]
    scored = sheet_tokens(spark, d).select("token", F.explode(entities.score(F.col("token"))).alias("s"))
    return scored.where(F.col("s.entity").isin(kinds)).select("token", F.col("s.entity").alias("kind"), F.round("s.confidence", 9).alias("confidence"))
