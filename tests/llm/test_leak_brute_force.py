"""Decontamination against a plain version, window by window."""

import random

from helpers import documents, leaks
from test_leak_edits import QUESTION, caught

from clinspark.llm.common import table
from clinspark.llm.queries import queries

ITEMS = [
    QUESTION,
    "What is the capital of France",
    "Add 3 kg 5 g and 7 kg 9 g to 12 kg 4 g then 8 kg 6 g or 1 kg 2 g",
    "In the year 1,999 the company of Mr Baker sold 2.5 tons of flour, and Anna bought 3 of them for 1,250 dollars",
    "a train leaves at 9 and another leaves at 10 in the same direction; how many km are between them after 3 hours",
    "Paris",
]


def refilled(r, text):
    """A copy with other numbers, names, cases, and single edits."""
    words = text.split(" ")
    names, numbers = {}, {}
    mode = r.choice(["same", "fill", "torn", "edit", "case", "part"])
    out = []
    for w in words:
        if mode in ("fill", "torn") and w[:1].isupper() and out:
            w = names.setdefault(w, r.choice(["Peter", "Mary Ann", "Susan"]))
        elif mode in ("fill", "torn") and w[:1].isdigit():
            fresh = r.choice(["2.5", "77", "1,250", "8"])
            w = fresh if mode == "torn" else numbers.setdefault(w, fresh)
        elif mode == "edit" and r.random() < 0.1:
            w = r.choice(["other", "", "more words", w + " " + w])
        out.append(w)
    t = " ".join(out)
    if mode == "part":
        t = " ".join(words[: r.randint(1, len(words))])
    return r.choice([t, t.upper(), t.lower(), "x. " + t + "! Yes", t.replace(" ", "\n", 1)]) if mode == "case" else r.choice(["", "Well so. "]) + t + r.choice(["", " and so on"])


def test_leaks_of_refilled_copies_equal_a_plain_version(spark):
    r = random.Random(31)
    docs = [refilled(r, r.choice(ITEMS)) for _ in range(150)] + [refilled(r, ITEMS[0]) + " " + refilled(r, ITEMS[3]) for _ in range(20)] + ["", None]
    got = caught(spark, docs, ITEMS)
    want = leaks(list(enumerate(docs)), list(enumerate(ITEMS)))
    assert {k: (x.windows, round(x.coverage, 9), x.changed_slots) for k, x in got.items()} == want
    assert len(want) > 80


def test_the_query_equals_a_plain_version_on_the_tables(spark, tiny):
    docs = [(x.doc_id, x.text) for x in table(spark, tiny, "documents").collect()]
    items = [(x.item_id, x.text) for x in table(spark, tiny, "benchmark").collect()]
    got = {(x.doc_id, x.item_id): (x.windows, round(x.coverage, 9), x.changed_slots) for x in queries()["op2_decontamination"](spark, tiny).collect()}
    assert got == leaks(docs, items) and got


def test_very_long_texts_and_repeated_rows_leak_once(spark):
    text = "word of no meaning " * 30_000 + QUESTION
    from clinspark.llm import decontaminate

    rows = decontaminate.op2(spark, documents(spark, [(1, text), (1, text), (2, "x" * 300_000)]), spark.createDataFrame([(0, QUESTION), (0, QUESTION)], "item_id long, text string")).collect()
    assert [(x.doc_id, x.item_id, x.coverage) for x in rows] == [(1, 0, 1.0)]
