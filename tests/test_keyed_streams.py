import datetime

import pytest
from pyspark.sql import functions as F

from clinspark.streaming import keyed

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime.datetime(2024, 1, 1)


def rows(ids, day=0):
    return [(i, START + datetime.timedelta(days=day, minutes=(i * 37) % 1440), i % 3 if i % 10 else None, "ab"[i % 2], float(i % 7)) for i in ids]


def put(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def last(data, keep):
    out = {}
    for i, ts, user, _, v in sorted(data, key=lambda r: (r[1], r[0])):
        if user is not None:
            out.setdefault(user, []).append((ts, i, v))
    return {u: (len(x), x[-keep:]) for u, x in out.items()}


def test_buffers_go_on_after_a_restart_and_place_late_rows(spark, tmp_path):
    files, state = str(tmp_path / "in"), str(tmp_path / "state")
    first, second, late = rows(range(40), 1), rows(range(40, 55), 2), rows(range(100, 112), 0)
    put(spark, files, "a", first)
    read = lambda: {r.user_id: (r.seen, [tuple(k) for k in r.kept]) for r in keyed.last_rows(spark, stream(spark, files), 6, state).collect()}
    assert read() == last(first, 6)
    put(spark, files, "b", second)
    put(spark, files, "c", late)
    assert read() == last(first + second + late, 6)
    assert read() == last(first + second + late, 6)  # nothing new


def test_refits_by_rows_and_by_time(spark, tmp_path):
    files = str(tmp_path / "in")
    for day, ids in enumerate((range(30), range(30, 36), range(36, 40), range(40, 44))):
        put(spark, files, f"f{day}", rows(ids, 3 * day))
    got = keyed.refits(spark, stream(spark, files), 10, 3_600_000, "1 hour", str(tmp_path / "state")).collect()
    by = {"a": {}, "b": {}}
    for r in got:
        by[r.event_type][r.fits] = r
    for fits in by.values():
        assert sorted(fits) == list(range(1, len(fits) + 1)) and fits[1].by == "rows" and fits[1].n == 15
        assert [fits[k].n for k in sorted(fits)] == sorted(fits[k].n for k in fits)
    assert any(r.by == "time" for r in got)
    values = [r[4] for r in rows(range(30)) if r[3] == "a"]
    mean = sum(values) / len(values)
    assert by["a"][1].mean == pytest.approx(mean) and by["a"][1].spread == pytest.approx((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5)


def test_buffers_of_the_tables_equal_the_batch(spark, tiny):
    got = {r.user_id: (r.seen, [k.event_id for k in r.kept]) for r in keyed.buffered_events(spark, tiny).collect()}
    events = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    want = last([tuple(r) for r in events.collect()], 5)
    assert got == {u: (n, [i for _, i, _ in k]) for u, (n, k) in want.items()}
