import random

import numpy as np
from pyspark.sql import functions as F

from clinspark.operators import learning, ordered, records
from clinspark.sources import store
from clinspark.streaming import ingest


def test_chain_finds_tampering(spark):
    rows = spark.createDataFrame([("g", i, f"p{i}") for i in range(6)], "g string, i int, p string")
    built = ordered.chain(rows, "g", ["i"], ["i", "p"])
    ok = ordered.verify_chain(built, "g", ["i"], ["i", "p"])
    assert ok.where("content_ok AND link_ok").count() == 6
    bad = ordered.verify_chain(built.withColumn("p", F.when(F.col("i") == 3, "x").otherwise(F.col("p"))), "g", ["i"], ["i", "p"])
    assert [r.i for r in bad.where("NOT content_ok").collect()] == [3]
    gone = ordered.verify_chain(built.where("i <> 2"), "g", ["i"], ["i", "p"])
    assert [r.i for r in gone.where("NOT link_ok").collect()] == [3]


def test_bands_follow_a_running_mean():
    assert ordered.bands([], 5) == []
    assert ordered.bands([0, 4, 8, 30, 33], 6) == [0, 0, 0, 1, 1]
    assert ordered.bands([0, 6, 9.1], 6) == [0, 0, 1]


def test_matching_is_greedy_and_one_to_one(spark):
    random.seed(3)
    pairs = [(g, a, b, random.randint(1, 6)) for g in range(3) for a in range(6) for b in range(6) if random.random() < 0.6]
    got = {(r.g, r.a, r.b) for r in records.one_to_one(spark.createDataFrame(pairs, "g int, a int, b int, s int"), "g", "a", "b", "s").collect()}
    want, left, right = set(), set(), set()
    for g, a, b, _ in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (g, a) not in left and (g, b) not in right:
            want.add((g, a, b))
            left.add((g, a))
            right.add((g, b))
    assert got == want


def test_groups_are_components(spark):
    nodes = spark.range(12).withColumnRenamed("id", "k")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (9, 8)], "src long, dst long")
    got = {r.k: r.group for r in records.merge_groups(nodes, "k", edges).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11}


def test_isotonic_fit_never_falls():
    x, y = learning.pool_adjacent(np.arange(6.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9, 0.2]), np.ones(6))
    assert (np.diff(y) >= 0).all() and len(x) == len(y)


def test_platt_needs_thirty_rows_and_orders_scores(spark):
    few = spark.createDataFrame([(0.5, 1)] * 10, "s double, y int")
    assert learning.platt(few, "s", "y") is None
    many = spark.createDataFrame([(i / 100, int(i + 20 * ((i * 7) % 3 - 1) > 50)) for i in range(100)], "s double, y int")
    slope, _ = learning.platt(many, "s", "y")
    assert slope > 0


def test_upsert_keeps_the_last_version_and_delete_removes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, n int")
    both = store.upsert(old, new, "k", "n")
    assert {(r.k, r.v) for r in both.collect()} == {(1, "c"), (2, "b"), (3, "e")}
    assert store.delete(both, spark.createDataFrame([(2,)], "k int"), "k").count() == 2
    assert store.first_non_empty([old.limit(0), new]).count() == 3


def test_exports_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'say "x"', 0), (2, None, 3)], "k int, v string, n int")
    store.write_census_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {tuple(r) for r in back.collect()} == {("1", 'say "x"', None), ("2", None, "3")}
    (tmp_path / "x.jsonl").write_text('{"k": 1}\n\nnot json\n{"k": 2}\n')
    assert sorted(r.k for r in store.read_jsonl(spark, str(tmp_path / "x.jsonl"), "k int").where("k IS NOT NULL").collect()) == [1, 2]


def test_isolated_points_are_noise(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, "g"), (2, 0.5, 0.0, "g"), (3, 9.0, 9.0, "g")], "k long, x double, y double, g string")
    edges, nodes = ordered.dbscan(pts, "k", "x", "y", 1.0, "g")
    assert {r.k for r in nodes.collect()} == {1, 2}
    _, every = ordered.dbscan(pts, "k", "x", "y", 1.0, "g", keep_singletons=True)
    assert records.merge_groups(every, "k", edges).where("k = 3 AND group = 3").count() == 1


def test_stream_drops_repeats_and_counts_windows(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.union(events.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = ingest.audit_ingest(stream).writeStream.format("memory").queryName("audited").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("audited").count() == events.count()
    run = ingest.windowed_counts(stream, late="10 minutes").writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == events.count() + 50


def test_a_learner_goes_on_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3, 1.5) for i in range(9)], "event_id long, user_id long, value double")
    where, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/learner"
    events.where("event_id < 5").coalesce(1).write.parquet(f"{where}/events.parquet")
    source = lambda: str(tmp_path / "in" / "events.parquet")
    import clinspark.streaming.ingest as I

    schema = events.schema

    def stream(_spark, d):
        return spark.readStream.schema(schema).parquet(d)

    before, I.event_stream = I.event_stream, stream
    try:
        first = {r.user_id: (r.n, r.total) for r in I.learn_counts(spark, source(), folder).collect()}
        events.where("event_id >= 5").coalesce(1).write.mode("append").parquet(f"{where}/events.parquet")
        second = {r.user_id: (r.n, r.total) for r in I.learn_counts(spark, source(), folder).collect()}
        again = {r.user_id: (r.n, r.total) for r in I.learn_counts(spark, source(), folder).collect()}
    finally:
        I.event_stream = before
    assert first == {0: (2, 3.0), 1: (2, 3.0), 2: (1, 1.5)} and second == again == {0: (3, 4.5), 1: (3, 4.5), 2: (3, 4.5)}
    I.merge_counts(events.where("event_id >= 5"), 1, folder)
    assert {r.user_id: r.n for r in spark.read.parquet(f"{folder}/state-1").collect()} == {0: 3, 1: 3, 2: 3}


def test_groups_by_parts_of_a_second_as_in_sql(spark, tmp_path):
    import duckdb

    from clinspark.plans import ordered as plans

    table = f"'{tmp_path}/events.parquet'"
    duckdb.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:00.9' + to_microseconds(i * (21600000000 - 300000) + (i % 3) * 500000) AS ts, i % 2 AS user_id, 0.0::DOUBLE AS value FROM range(12) r(i)
        UNION ALL SELECT 100 + i, TIMESTAMP '2024-03-01' + to_microseconds(i * 21600000000), 7, 1.0 FROM range(4) r(i)
        UNION ALL SELECT 200 + i, TIMESTAMP '2024-03-01 00:00:00.1' + to_microseconds(i * 21600800000), 8 + i // 4, 1.0 FROM range(8) r(i)) TO {table} (FORMAT parquet)""")
    want = duckdb.sql(plans.SQL["dbscan_groups"].replace("FROM events", f"FROM {table}")).fetchall()
    got = [(r.event_id, r.group) for r in plans.dbscan_groups(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert len([g for g in got if g[0] in range(100, 104)]) == 4 and not [g for g in got if g[0] >= 200]


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(records, "dealt", lambda rows, *by, n: seen.append((by, n)) or rows.repartition(max(n, 1), *by))
    got = records.one_to_one(spark.createDataFrame([(1, 1, 1, 9), (1, 1, 2, 8), (1, 2, 1, 8)], "g int, a int, b int, s int"), "g", "a", "b", "s")
    assert {(r.a, r.b) for r in got.collect()} == {(1, 1)}
    assert seen[:2] == [(("g", "a"), 3), (("g", "b"), 3)]
