"""Made-up reports and vocabularies from the tables' names and words, and records assembled from the tables' texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspark.operators import assembly, generators, text_rules
from clinspark.sources.store import scan

QUERIES, SQL = {}, {}
TESTS = [("Sodium", "mmol/L", 1350, 1450), ("Potassium", "mmol/L", 35, 51), ("Hemoglobin", "g/dL", 120, 160)]
DIAGNOSES = {"Pneumonia": 5.0, "Sepsis": 2.0, "Asthma": 3.0}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _unit(salt: str, key: str = "key") -> str:
    return f"(CAST('0x' || md5({salt} || ':' || {key})[1:8] AS BIGINT) / 4294967296.0)"


def _line(test: str, u: str, low: int, high: int) -> str:
    a, b = low - low // 3, high + high // 3
    value = f"CAST({a} + floor({_unit(repr(test))} * {b - a + 1}) AS BIGINT)"
    has = repr(f"has {test}")
    return f"CASE WHEN {_unit(has)} < 0.6 THEN '{test}: ' || ({value} // 10) || '.' || ({value} % 10) || ' {u} (Ref: {low // 10}.{low % 10}-{high // 10}.{high % 10})' END"


@query(f"""
WITH p AS (SELECT c_custkey AS key, c_name AS name FROM customer),
t AS (SELECT key, concat_ws(chr(10), 'Patient: ' || coalesce(name, ''), 'Age: ' || CAST(18 + floor({_unit("'age'")} * 73) AS BIGINT),
  'Diagnosis: ' || CASE WHEN {_unit("'dx'")} < 0.5 THEN 'Pneumonia' WHEN {_unit("'dx'")} < 0.7 THEN 'Sepsis' ELSE 'Asthma' END,
  {", ".join(_line(*t) for t in TESTS)}) AS truth, 0.05 + {_unit("'rate'")} * 0.2 AS rate FROM p),
w AS (SELECT key, rate, truth, unnest(string_split(truth, ' ')) AS x, unnest(range(1, len(string_split(truth, ' ')) + 1)) AS i FROM t)
SELECT key, truth, string_agg(CASE WHEN {_unit("'w' || i")} < rate THEN translate(x, 'olesB', '01358') ELSE x END, ' ' ORDER BY i) AS garbled FROM w GROUP BY 1, 2""")
def lab_reports(spark, d):
    """A report for each customer, and the same as a recogniser may misread it."""
    return generators.lab_reports(scan(spark, d, "customer"), "c_custkey", "c_name", TESTS, DIAGNOSES)


@query("""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM conversations),
h AS (SELECT word, j, md5(word || ':' || j) AS h FROM w, range(1, 61) AS r(j)),
n AS (SELECT word, j, CAST('0x' || h[1:8] AS BIGINT) % length(word) AS p, CAST('0x' || h[9:16] AS BIGINT) % 3 AS op, CAST('0x' || h[17:24] AS BIGINT) % 26 AS c FROM h),
v AS (SELECT word, j, substr(word, 1, p) || CASE op WHEN 0 THEN chr(CAST(97 + c AS INTEGER)) WHEN 1 THEN '' ELSE repeat(substr(word, p + 1, 1), 2) END || substr(word, p + 2) AS variant FROM n),
f AS (SELECT word, variant, min(j) AS j FROM v WHERE variant <> word GROUP BY 1, 2)
SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY j) AS INTEGER) AS rank, variant FROM f QUALIFY rank <= 20""")
def vocabulary_variants(spark, d):
    """Up to 20 slips of each word of the conversations."""
    words = scan(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"))).alias("word"))
    return generators.variants(words)


@query()
def assembled_records(spark, d):
    """Each line of the conversations as one record, unknown words resolved by what it lacks."""
    texts = scan(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    upper = text_rules.plain_text_words(texts, "doc_id", "text").withColumn("upper", F.upper(F.trim("text")))
    words = upper.withColumns({"entity": text_rules.classify_token(F.col("text"), upper=F.col("upper")), "confidence": F.lit(0.9)}).withColumnRenamed("line", "row_id").drop("upper")
    return assembly.assemble(words, F.array(F.lit("omar"), F.lit("sara")), F.array(F.lit("sepsis"), F.lit("ward")))
