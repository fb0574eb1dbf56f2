"""Corrections, merges of learned state, generated records and calibrator choice as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinspark.functions.scalar import metric_key, text_density
from clinspark.operators import learning
from clinspark.sources.store import cut_lineage, scan

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH tx AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500)
SELECT o_orderkey, count(l_orderkey) AS corrections, coalesce(CAST(sum((l_returnflag = 'R')::INT) AS BIGINT), 0) AS changed FROM tx LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def transaction_corrections(spark, d):
    """The latest 500 transactions with their corrections: the bounded side is found first, then joined."""
    tx = scan(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)
    lines = scan(spark, d, "lineitem").select("l_orderkey", "l_returnflag")
    j = tx.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("corrections"), F.coalesce(F.sum((F.col("l_returnflag") == "R").cast("int")), F.lit(0)).cast("long").alias("changed"))


@query("""
SELECT count(*) AS pairs, count(*) FILTER (a.c_mktsegment <> b.c_mktsegment) AS edited FROM customer a JOIN customer b ON a.c_custkey + 1 = b.c_custkey WHERE a.c_nationkey IS NOT NULL""")
def edited_records(spark, d):
    """Records that share a key with an imported one but differ in a field."""
    a = scan(spark, d, "customer").where("c_nationkey IS NOT NULL").select((F.col("c_custkey") + 1).alias("k"), F.col("c_mktsegment").alias("x"))
    b = scan(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("y"))
    return a.join(b, "k").agg(F.count("*").alias("pairs"), F.count_if(F.col("x") != F.col("y")).alias("edited"))


@query("""
SELECT source, count(*) AS documents, CAST(sum(quality) AS BIGINT) AS verified, CAST(sum(1 - quality) AS BIGINT) AS edited, CAST(floor(100.0 * sum(quality) / count(*) + 0.5) AS BIGINT) AS accuracy, list_sort(list(DISTINCT lang)) AS langs
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def learning_merge(spark, d):
    """Counters of a document source after all reviews: sums, accuracy in per cent, and the union of what was seen."""
    j = scan(spark, d, "documents").select("doc_id", "source", "lang").join(scan(spark, d, "labels"), "doc_id")
    return j.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("quality").cast("long").alias("verified"), F.sum(1 - F.col("quality")).cast("long").alias("edited"),
        F.floor(100.0 * F.sum("quality") / F.count("*") + 0.5).cast("long").alias("accuracy"), F.array_sort(F.collect_set("lang")).alias("langs"),
    )


@query("""
SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS input, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS output FROM conversations GROUP BY 1""")
def seed_export(spark, d):
    """Input and output of each conversation, ready to be written as lines of JSON."""
    c = scan(spark, d, "conversations")
    side = lambda role: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda s: s["text"]), "\n")
    return c.groupBy("conv_id").agg(side("user").alias("input"), side("assistant").alias("output")).select("conv_id", F.nullif("input", F.lit("")).alias("input"), F.nullif("output", F.lit("")).alias("output"))


@query("""
SELECT user_id, count(*) AS frames, count(*) FILTER (event_type = 'purchase') AS accepted, max(ts) AS last_ts, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1""")
def session_stats(spark, d):
    return scan(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("frames"), F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.max("ts").alias("last_ts"), F.count_distinct("event_type").alias("kinds"))


@query("""
SELECT doc_id, source, md5(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))) AS key FROM documents WHERE source IN ('src1', 'src2') AND text IS NOT NULL""")
def document_search(spark, d):
    return scan(spark, d, "documents").where(F.col("source").isin("src1", "src2") & F.col("text").isNotNull()).select("doc_id", "source", F.md5(metric_key(F.col("text"))).alias("key"))


@query()
def generated_records(spark, d):
    """Synthetic records from a range and hashes: the same ones every time, on any number of machines."""
    pick = lambda salt, xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))).cast("int"))
    n = scan(spark, d, "customer").count()
    r = spark.range(n).select("id", F.concat(pick("b", ["A", "B", "ICU"]), F.lit("-"), F.pmod(F.xxhash64("id", F.lit("n")), F.lit(40)).cast("string")).alias("bed"), pick("f", ["Omar", "Sara", "Ali"]).alias("name"), (F.pmod(F.xxhash64("id", F.lit("a")), F.lit(90)) + 1).cast("int").alias("age"), pick("d", ["STEMI", "UTI", "COPD", "DM2"]).alias("dx"))
    return r.withColumn("line", F.concat_ws(" | ", "bed", "name", F.col("age").cast("string"), "dx"))


@query()
def calibrator_choice(spark, d):
    """The calibrator of the lower calibration error on the fitted rows; too few rows leave scores as they are."""
    docs = scan(spark, d, "documents").select("doc_id", text_density(F.col("text")).alias("score"), F.lit("all").alias("field")).where("score IS NOT NULL").join(scan(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    docs = cut_lineage(docs)  # the fits and both diagrams read it
    fit = learning.platt(docs, "score", "quality")
    if fit is None:
        return spark.createDataFrame([("identity", None, None)], "choice string, platt_ece double, isotonic_ece double")
    a, b = fit
    curve = learning.isotonic(docs, "field", "score", "quality").groupBy("field").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("c"))
    both = docs.join(F.broadcast(curve), "field").withColumns({"platt": 1 / (1 + F.exp(-(F.lit(a) * F.col("score") + F.lit(b)))), "iso": F.coalesce(F.try_element_at(F.filter("c", lambda p: p["x"] <= F.col("score")), F.lit(-1))["y"], F.get("c", F.lit(0))["y"])})
    ece = lambda c: learning.calibration_error(learning.reliability(both, c, "quality")).first()[0]
    p, i = float(ece("platt")), float(ece("iso"))
    return spark.createDataFrame([("platt" if p <= i else "isotonic", p, i)], "choice string, platt_ece double, isotonic_ece double")
