"""Windows, chains, layout and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clinspark.operators import ordered, records, text_rules
from clinspark.sources.store import scan
from clinspark.streaming import ingest

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT event_id, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS context FROM events""")
def fill_down_context(spark, d):
    return ordered.fill_down(scan(spark, d, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type").isin("signup", "error"), F.col("event_type")), "context").select("event_id", "context")


@query("""
SELECT event_id, coalesce(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1 AS after_error FROM events""")
def lookback_flag(spark, d):
    return ordered.look_back(scan(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3, "after_error").select("event_id", "after_error")


@query("""
SELECT user_id, session, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM (
  SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events)) GROUP BY 1, 2""")
def gaps_and_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    e = scan(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("gap", gap)
    return ordered.islands(e, "user_id", ["ts", "event_id"], F.col("gap") > 30 * 60 * 1_000_000, "session").groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("""
WITH h AS (SELECT user_id, event_id, ts, sha256(CAST(event_id AS VARCHAR) || '|' || event_type || '|' || props) AS record_hash FROM events),
l AS (SELECT *, lag(record_hash) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM h),
t AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE coalesce(before, 'GENESIS') END AS prev_hash FROM l)
SELECT event_id, record_hash, prev_hash, event_id % 89 <> 0 AS content_ok, prev_hash = coalesce(before, 'GENESIS') AS link_ok FROM t""")
def hash_chain_verify(spark, d):
    """Chains of events, some of which were changed after they were hashed, and some of whose links were forged."""
    payload = ["event_id", "event_type", "props"]
    built = ordered.chain(scan(spark, d, "events"), "user_id", ["ts", "event_id"], payload)
    changed = built.withColumns({"props": F.when(F.col("event_id") % 89 == 0, F.concat("props", F.lit("!"))).otherwise(F.col("props")), "prev_hash": F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("prev_hash"))})
    return ordered.verify_chain(changed, "user_id", ["ts", "event_id"], payload).select("event_id", "record_hash", "prev_hash", "content_ok", "link_ok")


@query("""
WITH a AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations)
SELECT conv_id, turn, asked FROM a WHERE role = 'assistant'""")
def conversation_context(spark, d):
    c = ordered.fill_down(scan(spark, d, "conversations"), "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("turn")), "asked")
    return c.where("role = 'assistant'").select("conv_id", "turn", "asked")


@query("""
WITH w AS (SELECT o_custkey AS doc_id, 10.0 * (o_orderkey % 40) + CASE WHEN o_orderkey % 3 = 0 THEN 1000.0 ELSE 0.0 END + 5.0 * (o_custkey % 7) AS cx, 20.0 + o_orderkey % 11 AS w FROM orders),
g AS (SELECT *, lag(cx) OVER (PARTITION BY doc_id ORDER BY cx) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY cx) AS i FROM w),
s AS (SELECT doc_id, count(*) AS n, avg(w) AS a, max(cx) - min(cx) AS span, max(cx - before) AS gap FROM g GROUP BY 1),
b AS (SELECT g.doc_id, (cx + before) / 2 AS split, i, n, row_number() OVER (PARTITION BY g.doc_id ORDER BY i) AS r FROM g JOIN s ON g.doc_id = s.doc_id AND cx - before = gap WHERE gap > greatest(3.2 * a, 0.12 * span))
SELECT doc_id, CAST(split AS DOUBLE) AS split FROM b WHERE r = 1 AND i - 1 >= 4 AND n - i + 1 >= 4""")
def lane_split(spark, d):
    """Where the entries of a page, laid out in one or two lanes, fall apart."""
    k, page = F.col("o_orderkey"), F.col("o_custkey")
    cx = 10.0 * (k % 40) + F.when(k % 3 == 0, 1000.0).otherwise(0.0) + 5.0 * (page % 7)
    words = scan(spark, d, "orders").select(page.alias("doc_id"), cx.alias("cx"), (20.0 + k % 11).alias("w"))
    return ordered.lanes(words, "doc_id", "cx", "w")


@query("""
WITH l AS (SELECT item_id AS doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM benchmark),
w AS (SELECT doc_id, line, string_split(trim(regexp_replace(raw, '[ \\t]+', ' ', 'g')), ' ') AS ws FROM l WHERE length(trim(raw)) > 2)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(generate_subscripts(ws, 1) - 1 AS INTEGER) AS i, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS INTEGER) AS row_id FROM w""")
def row_bands(spark, d):
    """Words of plain text, by rows of a running mean."""
    words = text_rules.plain_text_words(scan(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", "text")
    return ordered.row_bands(words).select("doc_id", "line", "i", "row_id")


@query()
def text_to_records(spark, d):
    """Plain text through boxes, rows and entity scores to records."""
    words = text_rules.plain_text_words(scan(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "doc_id", "text")
    rows = ordered.row_bands(words).withColumn("entity", text_rules.classify_token(F.col("text"))).withColumn("confidence", F.lit(0.9))
    return ordered.records_from_words(rows)


@query("""
WITH RECURSIVE p AS (SELECT event_id, user_id, epoch(ts) / 3600.0 AS x, value AS y FROM events),
e AS (SELECT a.event_id AS x, b.event_id AS y FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 36),
r(id, x) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.x)
SELECT id AS event_id, min(x) AS "group" FROM r GROUP BY 1""")
def dbscan_groups(spark, d):
    """Events of a user that lie close in time and value."""
    e = scan(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0).alias("x"), F.col("value").alias("y"))
    edges, nodes = ordered.dbscan(e, "event_id", "x", "y", 6.0, "user_id")
    return records.merge_groups(nodes, "event_id", edges)


@query("""
SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def stream_learner(spark, d):
    """Counters that a stream over the event files updates batch by batch; they end as the batch aggregate does."""
    return ingest.learn_counts(spark, d)


@query("""
SELECT user_id, count(*) AS n, min(ts) AS start_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts FROM (
  SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events)) GROUP BY user_id, k""")
def session_windows(spark, d):
    e = scan(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", "n", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"))
