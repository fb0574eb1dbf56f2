"""Made-up data: distributions, and the same rows for any number of partitions."""

from pyspark.sql import functions as F

from clinspark.operators import generators
from clinspark.plans import generation


def test_draws_follow_the_weights(spark):
    got = dict(spark.range(40_000).select(generators.draw(F.col("id"), "dx", generation.DIAGNOSES).alias("v")).groupBy("v").count().collect())
    for value, weight in generation.DIAGNOSES.items():
        assert abs(got[value] / 40_000 - weight / 10) < 0.015


def test_partitions_change_nothing(spark):
    people = spark.range(500).select("id", F.concat(F.lit("Bo le"), F.col("id").cast("string")).alias("name"))
    one, many = (generators.lab_reports(people.repartition(n), "id", "name", generation.TESTS, generation.DIAGNOSES).collect() for n in (1, 200))
    assert sorted(one) == sorted(many) and any(r.truth != r.garbled for r in one)
    words = spark.createDataFrame([("pneumonia",), ("ab",), ("pneumonia",), ("x",), (None,), ("",)], "word string")
    a, b = (generators.variants(words.repartition(n)).collect() for n in (1, 50))
    assert sorted(a) == sorted(b)
    slips = [r.variant for r in a if r.word == "pneumonia"]
    assert len(slips) == len(set(slips)) == 20 and "pneumonia" not in slips and {r.word for r in a} == {"pneumonia", "ab"}
    assert sorted(r["rank"] for r in a if r.word == "pneumonia") == list(range(1, 21))
