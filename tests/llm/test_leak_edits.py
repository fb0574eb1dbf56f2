"""Copies of benchmark items that were edited, refilled or folded."""

from helpers import documents

from clinspark.llm import decontaminate
from clinspark.llm.common import table

QUESTION = "Once upon a time John had 15 apples and gave 7 of them to Mary before the 15 apples were sold at the market for profit"


def caught(spark, docs, items):
    rows = decontaminate.op2(spark, documents(spark, docs), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_one_edited_word_in_the_middle_hides_no_item(spark):
    items = {r.item_id: r.text for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()}
    docs = []
    for i, text in items.items():
        w = text.split(" ")
        k = len(w) // 2
        docs += [(3 * i, " ".join([*w[:k], "zzyzx", *w[k + 1 :]])), (3 * i + 1, " ".join([*w[:k], "zzyzx", *w[k:]])), (3 * i + 2, " ".join([*w[:k], *w[k + 1 :]]))]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op2(spark, documents(spark, docs), bench).collect()}
    assert not [(d, d // 3) for d, _ in docs if (d, d // 3) not in got]


def test_a_part_of_an_item_is_no_leak(spark):
    assert not caught(spark, ["gave 7 of them to Mary before the 15 apples", "nothing alike " * 9], [QUESTION])
