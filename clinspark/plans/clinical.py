"""Calculators, ranges, unit conversion and identity codes over the numeric columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspark.functions import clinical as C
from clinspark.functions.scalar import age_at, box_iou, civil_id_birth, decimal_alternatives, mrz_check_digit, mrz_date
from clinspark.sources.store import scan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, 80 + l_quantity AS sys, 50 + l_linenumber * 4 AS dia, 40 + l_quantity AS kg, 150 + l_linenumber * 5 AS cm, 130 + l_linenumber AS na, 100 + l_linenumber AS cl, 20 + l_linenumber AS hco3, l_quantity + 18 AS age FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(floor((sys + 2 * dia) / 3 + 0.5) AS BIGINT) AS map, na - cl - hco3 AS gap, floor(kg / pow(cm / 100, 2.0) * 10 + 0.5) / 10 AS bmi,
       floor(sqrt(kg * cm / 3600) * 100 + 0.5) / 100 AS bsa, CAST(floor((140 - age) * kg / (72 * 1.1) * CASE WHEN l_linenumber % 2 = 0 THEN 0.85 ELSE 1.0 END + 0.5) AS BIGINT) AS crcl,
       floor((8.0 + l_linenumber * 0.25 + 0.8 * (4 - 3.5)) * 10 + 0.5) / 10 AS calcium FROM x""")
def calculators(spark, d):
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    return scan(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", C.mean_arterial_pressure(80 + q, 50 + k * 4).alias("map"), C.anion_gap(130 + k, 100 + k, 20 + k).alias("gap"), C.bmi(40 + q, 150 + k * 5).alias("bmi"),
        C.bsa(40 + q, 150 + k * 5).alias("bsa"), C.cockcroft_gault(q + 18, 40 + q, F.lit(1.1), k % 2 == 0).alias("crcl"), C.corrected_calcium(8.0 + k * 0.25, F.lit(3.5)).alias("calcium"),
    )


@query("""
WITH x AS (SELECT o_orderkey, 18 + o_orderkey % 80 AS age, o_orderkey % 2 = 0 AS f, o_orderkey % 3 = 0 AS a, o_orderkey % 5 = 0 AS b, o_orderkey % 7 = 0 AS c, o_orderkey % 11 = 0 AS e FROM orders)
SELECT o_orderkey, CAST(CASE WHEN age >= 75 THEN 2 ELSE 0 END + CASE WHEN age >= 65 AND age < 75 THEN 1 ELSE 0 END + f::INT + a::INT + b::INT + c::INT + 2 * e::INT + (a AND b)::INT AS INTEGER) AS chads,
       CAST(a::INT + b::INT + c::INT + e::INT + f::INT + (age > 65)::INT AS INTEGER) AS bled, CAST(3.0 * a::INT + 3.0 * b::INT + 1.5 * c::INT + 1.5 * e::INT + 1.5 * f::INT AS DOUBLE) AS wells,
       CAST((age % 30 >= 22)::INT + (age <= 60)::INT + a::INT AS INTEGER) AS qsofa FROM x""")
def risk_scores(spark, d):
    o = F.col("o_orderkey")
    age, f, a, b, c, e, no = 18 + o % 80, o % 2 == 0, o % 3 == 0, o % 5 == 0, o % 7 == 0, o % 11 == 0, F.lit(False)
    return scan(spark, d, "orders").select(
        "o_orderkey", C.cha2ds2_vasc(age, f, a, b, c, e, a & b).alias("chads"), C.has_bled(a, b, c, e, f, no, age > 65, no, no).alias("bled"),
        C.wells_pe(a, b, c, e, f, no, no).alias("wells"), C.qsofa(age % 30, age + 40, a).alias("qsofa"),
    )


@query("""
SELECT p_partkey, CASE WHEN b IS NULL THEN NULL WHEN b < 18.5 THEN 'underweight' WHEN b < 25 THEN 'normal' WHEN b < 30 THEN 'overweight' ELSE 'obese' END AS band,
       CASE WHEN b < 10 OR b > 60 THEN 'impossible' WHEN b < 15 OR b > 45 THEN 'unusual' ELSE 'ok' END AS bounds,
       CASE WHEN b < 5 OR b > 70 THEN 'implausible' WHEN b < 12 THEN 'critical_low' WHEN b > 50 THEN 'critical_high' WHEN b < 18.5 THEN 'low' WHEN b > 30 THEN 'high' ELSE 'normal' END AS status
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * 1.3 AS b FROM part)""")
def interpretation_bands(spark, d):
    b = F.col("p_size").cast("double") * 1.3
    return scan(spark, d, "part").select("p_partkey", C.band(b, (18.5, "underweight"), (25, "normal"), (30, "overweight"), top="obese").alias("band"), C.check_bounds(b, (10, 60), (15, 45)).alias("bounds"), C.lab_status(b, 18.5, 30, 12, 50, (5, 70)).alias("status"))


@query("""
SELECT p_partkey, CAST(p_size * 18.0 AS DOUBLE) AS glucose, round(p_size / 18.0, 6) AS back, round(p_size * CAST(0.453592 AS DOUBLE), 6) AS kg, floor(p_size / 5.0 * 20.0 * 100 + 0.5) / 100 AS hydrocortisone, floor(p_size * 1.5 * 10 + 0.5) / 10 AS morphine FROM part""")
def unit_conversion(spark, d):
    x = F.col("p_size")
    return scan(spark, d, "part").select(
        "p_partkey", F.round(C.convert(x, "glucose", "mmol/L", "mg/dL"), 6).alias("glucose"), F.round(C.convert(x, "glucose", "mg/dL", "mmol/L"), 6).alias("back"), F.round(C.convert(x, "weight", "lb", "kg"), 6).alias("kg"),
        C.steroid_equivalent(x, "prednisone", "hydrocortisone").alias("hydrocortisone"), C.morphine_equivalent(x, "oxycodone").alias("morphine"),
    )


@query("""
SELECT o_orderkey, CAST(list_sum(list_transform(range(1, 10), lambda i: (CASE WHEN lpad(CAST(o_orderkey AS VARCHAR), 9, '0')[i] BETWEEN '0' AND '9' THEN CAST(lpad(CAST(o_orderkey AS VARCHAR), 9, '0')[i] AS INTEGER) ELSE 0 END) * CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END)) % 10 AS INTEGER) AS digit,
       CAST(CASE WHEN TRUE THEN strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') END AS DATE) AS day FROM orders""")
def mrz_codes(spark, d):
    """Check digits of padded numbers, and dates in six digits."""
    return scan(spark, d, "orders").select("o_orderkey", mrz_check_digit(F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).cast("int").alias("digit"), mrz_date(F.date_format("o_orderdate", "yyMMdd"), 30).alias("day"))


@query("""
SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN '19' ELSE '20' END || '-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS VARCHAR) IS NOT NULL AS coded,
       TRY_CAST((CASE WHEN o_orderkey % 2 = 0 THEN '19' ELSE '20' END || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0')) AS DATE) AS birth FROM orders""")
def civil_ids(spark, d):
    """Birth days in civil ids; those that are no days are null."""
    o = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    code = F.concat(F.when(o % 2 == 0, "2").otherwise("3"), two(o % 100), two(o % 13), two(o % 32), F.lit("00000"))
    return scan(spark, d, "orders").select("o_orderkey", F.lit(True).alias("coded"), civil_id_birth(code).alias("birth"))


@query("""
SELECT o_orderkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2024-06-30') / 365.25) AS INTEGER) AS age FROM orders""")
def ages(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", age_at(F.to_date("o_orderdate"), F.lit("2024-06-30").cast("date")).alias("age"))


@query("""
SELECT p_partkey, list_filter(list_transform(range(1, length(s)), lambda i: CAST(s[:i] || '.' || s[i + 1:] AS DOUBLE)), lambda x: x >= 3.0 AND x <= 20.0) AS options FROM (SELECT p_partkey, CAST(p_partkey * 37 AS VARCHAR) AS s FROM part)""")
def missing_decimals(spark, d):
    return scan(spark, d, "part").select("p_partkey", decimal_alternatives((F.col("p_partkey") * 37).cast("string"), 3.0, 20.0).alias("options"))


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_linenumber * 10.0 AS y, 20.0 AS w, 12.0 AS h FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_linenumber AS i, c.l_linenumber AS j, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS v FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.l_linenumber < c.l_linenumber)
SELECT l_orderkey, i, j, round(v / (480.0 - v), 6) AS iou FROM p WHERE v / (480.0 - v) > 0.05""")
def box_overlap(spark, d):
    """Boxes of one page that overlap: a theta join inside the page."""
    b = scan(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("l_quantity").alias("x"), (F.col("l_linenumber") * 10.0).alias("y"))
    c = b.select("l_orderkey", F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    w, h = F.lit(20.0), F.lit(12.0)
    iou = box_iou(F.col("x"), F.col("y"), w, h, F.col("x2"), F.col("y2"), w, h)
    return b.join(c, "l_orderkey").where("i < j").withColumn("iou", iou).where("iou > 0.05").select("l_orderkey", "i", "j", F.round("iou", 6).alias("iou"))
