import math

from clinspark.plans import catalog


def test_orders_of_every_customer_are_matched(spark, tmp_path):
    rows = [(c, o, "O", "1-URGENT") for c in (5, 300, 301, 90_000) for o in (c * 10 + 1, c * 10 + 2)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.page: r.matched for r in catalog.queries()["fieldwise_accuracy"](spark, str(tmp_path)).collect()}
    assert got == {5: 2, 300: 2, 301: 2, 90_000: 2}


def test_cards_of_every_customer_are_read(spark, tmp_path):
    keys = [1, 20, 21, 999, 1000, 123_456_789]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.c_custkey, r.place): r.value for r in catalog.queries()["tlv_decoding"](spark, str(tmp_path)).collect()}
    assert got == {(k, 0): str(k).zfill(3) for k in keys} | {(k, 1): "A" for k in keys}


def test_means_add_prices_in_the_order_of_orders(spark, tmp_path):
    """Sums whose last bit hangs on the order decide on which side of a half a mean lies."""
    import random

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    r, groups = random.Random(7), []
    while len(groups) < 40:
        p = [r.randrange(100_000, 40_000_000) for _ in range(7)]
        p.append(100_000 + (400 - (sum(p) + 100_000) % 800) % 800)
        x = [v / 100 for v in p]
        if math.floor(sum_of(x) / 8 + 0.5) != math.floor((sum_of(x[:4]) + sum_of(x[4:])) / 8 + 0.5):
            groups.append(x)
    n = len(groups)
    rows = pa.table({"o_orderkey": range(8 * n), "o_custkey": [i % n for i in range(8 * n)], "o_totalprice": [groups[i % n][i // n] for i in range(8 * n)]})
    pq.write_table(rows, f"{tmp_path}/orders.parquet", row_group_size=4 * n)
    con = duckdb.connect(config={"threads": 1})
    want = con.sql(catalog.oracle_sql()["running_means"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet'")).fetchall()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        got = [tuple(x) for x in catalog.queries()["running_means"](spark, str(tmp_path)).select("o_custkey", "avg_price", "n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(want)


def test_means_add_prices_in_the_order_of_the_files_rows(spark, tmp_path):
    """Orders that lie in their files in another order than that of their keys."""
    import random

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    r, groups = random.Random(8), []
    while len(groups) < 40:
        p = [r.randrange(100_000, 40_000_000) for _ in range(7)]
        p.append(100_000 + (400 - (sum(p) + 100_000) % 800) % 800)
        x = [v / 100 for v in p]
        if math.floor(sum_of(x) / 8 + 0.5) != math.floor(sum_of(x[::-1]) / 8 + 0.5):
            groups.append(x)
    n = len(groups)
    (tmp_path / "orders.parquet").mkdir()
    for part in range(2):
        places = range(4 * n * part, 4 * n * (part + 1))
        rows = pa.table({"o_orderkey": [8 * n - i for i in places], "o_custkey": [i % n for i in places], "o_totalprice": [groups[i % n][i // n] for i in places]})
        pq.write_table(rows, f"{tmp_path}/orders.parquet/part-{part}.parquet")
    con = duckdb.connect(config={"threads": 1})
    want = con.sql(catalog.oracle_sql()["running_means"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    got = [tuple(x) for x in catalog.queries()["running_means"](spark, str(tmp_path)).select("o_custkey", "avg_price", "n").collect()]
    assert sorted(got) == sorted(want)


def sum_of(values):
    total = 0.0
    for v in values:
        total += v
    return total


def test_the_choice_of_a_calibrator_scores_texts_once(spark, monkeypatch, tiny):
    from clinspark.operators import learning

    seen, plain = [], learning.isotonic
    monkeypatch.setattr(learning, "isotonic", lambda table, *a: seen.append(table.inputFiles()) or plain(table, *a))
    assert catalog.queries()["calibrator_choice"](spark, tiny).count() == 1
    assert seen == [[]]
