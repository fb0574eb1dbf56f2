"""Sheets and rosters as queries; the sheets are made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspark.operators import ordered, tables, text_rules
from clinspark.sources.store import scan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sheet(spark, d):
    """A sheet for each supplier nation: a header and a row for each supplier."""
    body = scan(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.concat(F.lit("B"), F.col("s_suppkey").cast("string"), F.lit("   Omar   67/M   STEMI")))).alias("rows"))
    words = text_rules.plain_text_words(body.select("doc_id", F.concat(F.lit("Bed   Name   Age   Diagnosis\n"), F.array_join("rows", "\n")).alias("text")), "doc_id", "text")
    return ordered.row_bands(words).withColumns({"entity": text_rules.classify_token(F.col("text")), "confidence": F.lit(0.9)})


@query()
def table_columns(spark, d):
    return tables.header_columns(_sheet(spark, d))


@query()
def table_records(spark, d):
    """Words below a header, by column and record."""
    words = _sheet(spark, d)
    below = tables.project_to_columns(words, tables.header_columns(words))
    return tables.records_of_table(below).groupBy("doc_id", "record_id").agg(F.max(F.when(F.col("role") == "bed", F.col("text"))).alias("bed"), F.max(F.when(F.col("role") == "name", F.col("text"))).alias("name"), F.max(F.when(F.col("role") == "dx", F.col("text"))).alias("dx"))


@query("""
WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS line, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT doc_id, line, 'p' || line AS identity, 'c' || lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS clinical FROM l WHERE n >= 3 QUALIFY i > 1""")
def roster_repair(spark, d):
    """Rosters whose clinical part sits one line early, set right."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    o = scan(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line"), F.min("o_orderkey").over(w).alias("lo"), F.max("o_orderkey").over(w).alias("hi"), F.count("*").over(w).alias("n")).where("n >= 3")
    lines = o.select("doc_id", "line", F.when(F.col("line") != F.col("lo"), F.concat(F.lit("p"), F.col("line").cast("string"))).alias("identity"), F.when(F.col("line") != F.col("hi"), F.concat(F.lit("c"), F.col("line").cast("string"))).alias("clinical"))
    return tables.repair_lag(lines)


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.84 WHEN 2 THEN 0.0 WHEN 3 THEN 0.66 ELSE 0.0 END::DOUBLE AS score FROM customer""")
def name_scores(spark, d):
    texts = F.array(*[F.lit(x) for x in ("Sara Khan", "Sara", "Stemi Shock", "Joe Bloggs", "R2D2 x")])
    known, clinical = F.array(F.lit("sara")), F.array(F.lit("stemi"), F.lit("shock"))
    return scan(spark, d, "customer").select("c_custkey", tables.name_score(F.get(texts, (F.col("c_custkey") % 5).cast("int")), known, clinical).alias("score"))


@query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 5 > 0 THEN least(1.0, 0.48 + 0.22 * l_quantity / 50 + 0.09 * least(l_linenumber % 5, 3) + 0.06 * least(l_partkey % 4, 3) + 0.08 * (l_linenumber % 2 = 0)::INT + 0.07 * (l_suppkey % 2 = 0)::INT) ELSE 0 END, 6) AS score FROM lineitem""")
def diagnosis_scores(spark, d):
    k, no = F.col("l_linenumber"), F.lit(False)
    s = tables.diagnosis_score(F.col("l_quantity") / 50, k % 5, F.col("l_partkey") % 4, F.lit(0), k % 2 == 0, F.col("l_suppkey") % 2 == 0, no)
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'mitral stenosis' WHEN 1 THEN 'multiple sclerosis' WHEN 2 THEN 'morphine' ELSE 'unclear' END AS sense FROM customer""")
def abbreviation_senses(spark, d):
    senses = [("mitral stenosis", ["valve", "echo"]), ("multiple sclerosis", ["neuro", "mri"]), ("morphine", ["mg", "pain"])]
    context = F.get(F.array(*[F.lit(x) for x in ("valve on echo", "MRI brain, neuro", "5 mg for pain", "none")]), (F.col("c_custkey") % 4).cast("int"))
    return scan(spark, d, "customer").select("c_custkey", tables.disambiguate(F.lit("MS"), context, senses, "unclear").alias("sense"))
