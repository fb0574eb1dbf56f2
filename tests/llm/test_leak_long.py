import time

from clinspark.llm import decontaminate as D

ITEM = "Tom Baker buys 12 apples and 7 ripe pears for 3.5 kg of fruit while his sister Anna waits outside the old market"


def test_long_repetitive_texts_cost_in_proportion(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    took = {}
    for words in (2_000, 20_000, 200_000):
        text = " . ".join([ITEM] * (words // 22))
        docs = spark.createDataFrame([(5, text), (6, None), (7, "")], "doc_id long, text string")
        began = time.perf_counter()
        got = D.leaks(spark, docs, items).collect()
        took[words] = time.perf_counter() - began
        assert [(r.doc_id, r.item_id, r.coverage, r.kind) for r in got] == [(5, 1, 1.0, "verbatim")]
    assert took[200_000] < 60, took
