"""Dashboards, searches, votes, distributions, set operations and joins over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinspark.functions.scalar import confidence_band, confidence_route, js_round
from clinspark.operators import learning, records
from clinspark.sources.store import delete, keep_last, paired_rows, quarantine, scan, upsert

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT coalesce(nullif(trim(n_name), ''), 'Unassigned') AS ward, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done,
       CAST(floor(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) + 0.5) AS BIGINT) AS pct
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def census_by_nation(spark, d):
    orders = scan(spark, d, "orders").join(scan(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(scan(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return records.census(orders, "n_name", "o_orderstatus", "F")


@query("""
SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-urgent", count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-high",
       count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-medium", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-low" FROM orders""")
def triage_counts(spark, d):
    return records.fixed_counts(scan(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query("""
SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS rank
FROM orders ORDER BY rank, o_totalprice DESC, o_orderkey LIMIT 50""")
def priority_sort_topk(spark, d):
    rank = records.rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return scan(spark, d, "orders").withColumn("rank", rank).orderBy("rank", F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "rank")


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') OR contains(lower(p_type), 'an')""")
def registry_search(spark, d):
    return records.search(scan(spark, d, "part"), " AN ", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


_Q = "list_sort(list(value))[least(CAST(floor(count(*) * {p}) AS BIGINT), count(*) - 1) + 1] AS {name}"


@query(f"""
SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
       {", ".join(_Q.format(p=p, name=n) for p, n in ((0.5, "median"), (0.1, "p10"), (0.25, "p25"), (0.75, "p75"), (0.9, "p90")))}
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def audit_distribution(spark, d):
    return records.distribution(scan(spark, d, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("""
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (value > 50) AS above,
       round(count(*) FILTER (value > 50) / count(*), 6) AS rate, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type""")
def audit_stats(spark, d):
    return scan(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("above"),
        F.round(F.count_if(F.col("value") > 50) / F.count("*"), 6).alias("rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("""
SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1""")
def count_by_key(spark, d):
    return scan(spark, d, "documents").groupBy(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 5""")
def keep_last_n(spark, d):
    return keep_last(scan(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "ts")


@query("""
WITH d AS (SELECT DISTINCT user_id AS g, event_type AS a FROM events)
SELECT x.a AS a, y.a AS b, count(*) AS n FROM d x JOIN d y ON x.g = y.g AND x.a < y.a GROUP BY 1, 2""")
def cooccurrence_pairs(spark, d):
    return learning.pair_counts(scan(spark, d, "events"), "user_id", "event_type")


@query("""
WITH f AS (SELECT row_number() OVER () AS id, unnest([struct_pack(f := 'l_returnflag', v := l_returnflag), struct_pack(f := 'l_linestatus', v := l_linestatus),
           struct_pack(f := 'l_linenumber', v := CAST(l_linenumber AS VARCHAR))]) AS s FROM lineitem)
SELECT a.s.f || ':' || a.s.v AS context, b.s.f AS target, b.s.v AS value, count(*) AS n FROM f a JOIN f b ON a.id = b.id AND a.s.f <> b.s.f GROUP BY 1, 2, 3""")
def context_chains(spark, d):
    return learning.context_chains(scan(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("""
WITH v AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS w, count(*) AS n, max(l_quantity) AS best FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_suppkey, w, n, best FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, n DESC, best DESC, l_suppkey) r FROM v) WHERE r = 1""")
def scalar_vote(spark, d):
    return records.scalar_vote(scan(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", "l_quantity")


@query("""
WITH v AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS w, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, n DESC, l_suppkey) AS r, max(w) OVER (PARTITION BY l_partkey) AS top FROM v),
j AS (SELECT l_partkey, l_suppkey, w, n, row_number() OVER (PARTITION BY l_partkey ORDER BY w DESC, n DESC, l_suppkey) AS rank FROM k WHERE n > 1 OR w >= greatest(0.58, 0.5 * top) OR r = 1)
SELECT l_partkey, l_suppkey, w, n, CAST(rank AS INTEGER) AS rank FROM j WHERE rank <= 6""")
def list_vote(spark, d):
    return records.list_vote(scan(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", "l_quantity")


@query("""
SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted, round(avg(l_discount), 6) AS plain FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def weighted_average(spark, d):
    t = scan(spark, d, "lineitem").where("l_quantity > 0")
    return t.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("weighted"), F.round(F.avg("l_discount"), 6).alias("plain"))


@query("""
SELECT doc_id, n_chars, key FROM (SELECT doc_id, n_chars, md5(lower(trim(text))) AS key, row_number() OVER (PARTITION BY md5(lower(trim(text))) ORDER BY n_chars DESC, doc_id) r FROM documents) WHERE r = 1""")
def ensemble_max(spark, d):
    docs = scan(spark, d, "documents").select("doc_id", "n_chars", F.md5(F.lower(F.trim("text"))).alias("k"))
    return records.best_per_key(docs, F.col("k"), "n_chars", "doc_id").select("doc_id", "n_chars", "key")


@query("""
SELECT key, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, substr(sha1(source || chr(10) || trim(text)), 1, 16) AS key FROM documents WHERE length(trim(text)) > 1) GROUP BY key""")
def exact_dedup(spark, d):
    docs = scan(spark, d, "documents").where(F.length(F.trim("text")) > 1)
    return docs.groupBy(F.substring(F.sha1(F.concat_ws("\n", "source", F.trim("text"))), 1, 16).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> ''
INTERSECT SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)""")
def intersection_overlap(spark, d):
    words = lambda t: scan(spark, d, t).select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return words("benchmark").intersect(words("documents"))


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) r FROM orders) WHERE r = 1""")
def first_match_join(spark, d):
    """Each customer with its latest order: an equi join that keeps the first match."""
    o = scan(spark, d, "orders").withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))).where("r = 1")
    return scan(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(o, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def not_selected(spark, d):
    return scan(spark, d, "customer").join(scan(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
WITH s AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS v, 1 AS version FROM supplier),
n AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS v, 2 AS version FROM customer),
u AS (SELECT * FROM n UNION ALL SELECT * FROM s WHERE id NOT IN (SELECT id FROM n))
SELECT * FROM u WHERE id NOT IN (SELECT n_nationkey FROM nation)""")
def upsert_delete(spark, d):
    s = scan(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS v", "1 AS version")
    n = scan(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS v", "2 AS version")
    return delete(upsert(s, n, "id", "version"), scan(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id"), "id")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_mktsegment <> '' THEN 'valid' ELSE 'quarantined' END AS sink FROM customer""")
def quarantine_sink(spark, d):
    good, bad = quarantine(scan(spark, d, "customer"), (F.col("c_acctbal") >= 0) & (F.col("c_mktsegment") != ""))
    return good.select("c_custkey", F.lit("valid").alias("sink")).unionByName(bad.select("c_custkey", F.lit("quarantined").alias("sink")))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN c >= 0.85 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS band,
       CASE WHEN c >= 0.92 THEN 'accepted' WHEN c >= 0.5 THEN 'review' ELSE 'rejected' END AS route
FROM (SELECT *, l_quantity / 50 AS c FROM lineitem)""")
def confidence_routing(spark, d):
    c = F.col("l_quantity") / 50
    return scan(spark, d, "lineitem").select("l_orderkey", "l_linenumber", confidence_band(c).alias("band"), confidence_route(c).alias("route"))


@query("""
SELECT status, count(*) AS n, round(avg(c), 4) AS avg_confidence FROM (
  SELECT CASE WHEN l_quantity / 50 >= 0.92 THEN 'accepted' WHEN l_quantity / 50 >= 0.5 THEN 'review' ELSE 'rejected' END AS status, l_quantity / 50 AS c FROM lineitem) GROUP BY 1""")
def result_summary(spark, d):
    c = F.col("l_quantity") / 50
    return scan(spark, d, "lineitem").select(confidence_route(c).alias("status"), c.alias("c")).groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("c"), 4).alias("avg_confidence"))


_ERRORS = [("PRICE", "o_totalprice <= 1000"), ("STATUS", "o_orderstatus = 'P'"), ("PRIORITY", "o_orderpriority = '1-URGENT'")]


@query("""
SELECT o_orderkey, list_filter([CASE WHEN o_totalprice <= 1000 THEN 'PRICE' END, CASE WHEN o_orderstatus = 'P' THEN 'STATUS' END,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'PRIORITY' END], lambda x: x IS NOT NULL) AS errors FROM orders""")
def record_validator(spark, d):
    return scan(spark, d, "orders").select("o_orderkey", records.validation_errors([(c, F.expr(e)) for c, e in _ERRORS]).alias("errors"))


@query("""
SELECT count(*) AS total, count(*) FILTER (e = 0) AS ready, CAST(sum(e) AS BIGINT) AS errors FROM (
  SELECT (o_totalprice <= 1000)::INT + (o_orderstatus = 'P')::INT + (o_orderpriority = '1-URGENT')::INT AS e FROM orders)""")
def batch_validator(spark, d):
    n = F.size(records.validation_errors([(c, F.expr(e)) for c, e in _ERRORS]))
    return scan(spark, d, "orders").select(n.alias("e")).agg(F.count("*").alias("total"), F.count_if(F.col("e") == 0).alias("ready"), F.sum("e").alias("errors"))


@query("""
WITH pairs AS (SELECT a.l_orderkey, a.l_partkey AS lo, b.l_partkey AS hi FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL),
known AS (SELECT * FROM (VALUES (0, 1, 'Major'), (1, 2, 'Contraindicated'), (2, 4, 'Moderate'), (0, 3, 'Minor')) t(x, y, severity))
SELECT l_orderkey, lo, hi, severity, CASE severity WHEN 'Contraindicated' THEN 0 WHEN 'Major' THEN 1 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 3 ELSE 4 END AS rank
FROM pairs JOIN known ON least(lo % 5, hi % 5) = x AND greatest(lo % 5, hi % 5) = y""")
def pair_interaction(spark, d):
    """Interacting pairs of one order: an unordered self-join against a small table of classes of parts."""
    known = spark.createDataFrame([(0, 1, "Major"), (1, 2, "Contraindicated"), (2, 4, "Moderate"), (0, 3, "Minor")], "x long, y long, severity string")
    items = scan(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("lo")).distinct()
    pairs = items.join(items.withColumnRenamed("lo", "hi"), "l_orderkey").where("lo < hi")
    found = pairs.join(F.broadcast(known), (F.least(F.col("lo") % 5, F.col("hi") % 5) == F.col("x")) & (F.greatest(F.col("lo") % 5, F.col("hi") % 5) == F.col("y")))
    return found.select("l_orderkey", "lo", "hi", "severity", records.rank_of(F.col("severity"), ["Contraindicated", "Major", "Moderate", "Minor"]).alias("rank"))


@query("""
WITH u AS (SELECT conv_id, list(turn ORDER BY turn) AS a FROM conversations WHERE role = 'user' GROUP BY 1),
s AS (SELECT conv_id, list(turn ORDER BY turn) AS b FROM conversations WHERE role = 'assistant' GROUP BY 1),
x AS (SELECT conv_id, unnest(a) AS l, generate_subscripts(a, 1) - 1 AS pos FROM u), y AS (SELECT conv_id, unnest(b) AS r, generate_subscripts(b, 1) - 1 AS pos FROM s)
SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, CAST(coalesce(x.pos, y.pos) AS INTEGER) AS pos, l AS "left", r AS "right" FROM x FULL JOIN y ON x.conv_id = y.conv_id AND x.pos = y.pos""")
def paired_export(spark, d):
    c = scan(spark, d, "conversations")
    turns = lambda role: c.where(F.col("role") == role).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    return paired_rows(turns("user"), turns("assistant"), "conv_id", "t", "t")


@query("""
SELECT c_mktsegment AS class, list_sort(list(c_name)) AS names FROM customer GROUP BY 1""")
def drug_categories(spark, d):
    return scan(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("class")).agg(F.sort_array(F.collect_list("c_name")).alias("names"))


@query("""
WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS t FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation),
reach(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM reach r JOIN e ON r.t = e.s)
SELECT CAST(s AS INTEGER) AS start, CAST(count(DISTINCT t) AS BIGINT) AS reachable FROM reach GROUP BY 1""")
def protocol_reach(spark, d):
    """Steps that can be reached in a step graph: a recursive query over the edge table."""
    scan(spark, d, "nation").createOrReplaceTempView("protocol_nation")
    return spark.sql("""
        WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS t FROM protocol_nation UNION SELECT n_nationkey, n_regionkey FROM protocol_nation),
        hops(s, t, n) AS (SELECT s, t, 1 FROM e UNION ALL SELECT s, t, n FROM (SELECT DISTINCT r.s, e.t, r.n + 1 AS n FROM hops r JOIN e ON r.t = e.s WHERE r.n < 25))
        SELECT s AS start, count(DISTINCT t) AS reachable FROM hops GROUP BY s""")


@query("""
SELECT grouping(l_returnflag) AS all_flags, grouping(l_linestatus) AS all_states, l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")
def validation_breakdown(spark, d):
    scan(spark, d, "lineitem").createOrReplaceTempView("breakdown_lineitem")
    return spark.sql("""SELECT CAST(grouping(l_returnflag) AS BIGINT) AS all_flags, CAST(grouping(l_linestatus) AS BIGINT) AS all_states, l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber) AS lines
        FROM breakdown_lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus))""")


@query("""
SELECT word, n FROM (SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY 1) ORDER BY n DESC, word LIMIT 10""")
def top_terms(spark, d):
    return scan(spark, d, "conversations").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


@query("""
SELECT o_custkey, CAST(floor(sum(o_totalprice) / count(*) + 0.5) AS BIGINT) AS avg_price, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1""")
def running_means(spark, d):
    """Rounded means; prices are added in the order of the files' rows, as a sum of doubles by parts or in another order may end on the other side of a half."""
    w = Window.partitionBy("o_custkey").orderBy("file_path", "row_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = scan(spark, d, "orders").select("o_custkey", "o_totalprice", "_metadata.file_path", "_metadata.row_index")
    sums = placed.select("o_custkey", F.sum("o_totalprice").over(w).alias("total"), F.count("*").over(w).alias("n"))
    ends = sums.groupBy("o_custkey").agg(F.max(F.struct("n", "total")).alias("e"))
    return ends.where("e.n > 1").select("o_custkey", js_round(F.col("e.total") / F.col("e.n")).alias("avg_price"), F.col("e.n").alias("n"))
