"""Fuzzy joins, weighted distances, linkage and rates against plain versions."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clinspark.functions import distance
from clinspark.functions.scalar import canonical_token
from clinspark.operators import fuzzy
from clinspark.plans import catalog
from clinspark.sources import codecs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def words():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc0Ol1") for _ in range(r.randint(0, 6)))
    return sorted({word() for _ in range(90)}), sorted({word() for _ in range(60)})


def rows(spark, values, name):
    return spark.createDataFrame([(v,) for v in [*values, None, values[0]]], f"{name} string")


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_pairs_within_edits_equal_brute_force(spark, words, limit):
    left, right = words
    got = {tuple(r) for r in fuzzy.near_pairs(rows(spark, left, "a"), "a", rows(spark, right, "b"), "b", limit).collect()}
    assert got == {(a, b, edits(a, b)) for a in left for b in right if edits(a, b) <= limit}


def test_nearest_terms_equal_brute_force(spark, words):
    left, right = words
    got = {r.a: (r.b, r.distance) for r in fuzzy.nearest_terms(rows(spark, left, "a"), "a", rows(spark, right, "b"), "b", 2).collect()}
    want = {a: min(((edits(a, b), b) for b in right if edits(a, b) <= 2), default=None) for a in left}
    assert got == {a: (w[1], w[0]) for a, w in want.items() if w}


def least_near(spark, left, right, limit):
    pairs = spark.createDataFrame([(x,) for x in left], "a string").crossJoin(spark.createDataFrame([(x,) for x in right], "b string"))
    best = pairs.withColumn("d", F.levenshtein("a", "b")).where(F.col("d") <= limit).groupBy("a").agg(F.min(F.struct("d", "b")).alias("m"))
    return {r.a: (r.m.b, r.m.d) for r in best.collect()}


def test_terms_close_to_each_other_are_not_met_in_pairs(spark, monkeypatch):
    terms, tokens = [f"Supplier#{i:09d}" for i in range(2000)], [f"Supplier#{i:09d}" for i in range(0, 60000, 41)]
    asked, pairs = [], fuzzy.segment_pairs

    def counted(l, t, r, u, e):
        asked.append(e)
        return pairs(l, t, r, u, e)

    monkeypatch.setattr(fuzzy, "segment_pairs", counted)
    got = {r.a: (r.b, r.distance) for r in fuzzy.nearest_terms(rows(spark, tokens, "a"), "a", rows(spark, terms, "b"), "b", 2).collect()}
    assert got == least_near(spark, tokens, terms, 2) and {d for _, d in got.values()} == {0, 1, 2}
    assert set(asked) == {0}


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_nearest_terms_of_any_start_and_length_equal_brute_force(spark, limit):
    r = random.Random(5)
    base = ["ab12" + "".join(r.choice("01,|é😀") for _ in range(r.randint(0, n))) for n in (3, 6, 20) for _ in range(25)]
    tokens = [*base[::5], "", "a", "ab1", "b12", "ab12"]
    for x in base * 2:
        for _ in range(r.randint(1, 3)):
            k = r.randint(0, len(x))
            x = r.choice([x[:k] + x[k + 1 :], x[:k] + r.choice("01x") + x[k:], x[:k] + r.choice("01,é") + x[k + 1 :]])
        tokens.append(x)
    got = {x.a: (x.b, x.distance) for x in fuzzy.nearest_terms(rows(spark, tokens, "a"), "a", rows(spark, base, "b"), "b", limit).collect()}
    assert got == least_near(spark, sorted(set(tokens)), sorted(set(base)), limit)
    assert fuzzy.nearest_terms(rows(spark, tokens, "a"), "a", rows(spark, base, "b").limit(0), "b", limit).count() == 0


def test_nearest_by_weight_equals_brute_force(spark, words):
    left, right = words
    got = fuzzy.nearest_by_weight(rows(spark, left, "a"), "a", rows(spark, right, "b"), "b", canonical_token, distance.ocr_distance, 2.0).collect()
    best = {a: min(((round(distance.weighted_distance(a, b), 9), b) for b in right if distance.weighted_distance(a, b) <= 2), default=None) for a in left}
    assert {r.a: (round(r.distance, 9), r.b) for r in got} == {a: w for a, w in best.items() if w}


def test_the_folded_distance_is_a_lower_bound(spark, words):
    left, right = words
    pairs = spark.createDataFrame(list(itertools.product(left[:40], right[:40])), "a string, b string")
    assert pairs.where(distance.lower_bound(F.col("a"), F.col("b")) > distance.ocr_distance(F.col("a"), F.col("b")) + 1e-9).count() == 0


def test_distances_of_a_batch_equal_those_of_pairs(monkeypatch):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abO0lI1|SZ5é") for _ in range(r.randint(0, 12)))
    a, b = ([None if r.random() < 0.05 else word() for _ in range(500)] for _ in range(2))
    want = [distance.weighted_distance(x, y) for x, y in zip(a, b, strict=True)]
    for cells in (distance.STEP_CELLS, 300):
        monkeypatch.setattr(distance, "STEP_CELLS", cells)
        got = distance._distances(pd.Series(a, dtype=object), pd.Series(b, dtype=object))
        assert [None if pd.isna(x) else round(x, 9) for x in got] == [None if x is None else round(x, 9) for x in want]
    assert distance._distances(pd.Series([], dtype=object), pd.Series([], dtype=object)).empty


def test_word_error_rate_counts_words_of_any_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(distance, "FIRST", 0xD7F0)  # so that the words' characters pass the surrogates
    r = random.Random(3)
    pairs = []
    for _ in range(20):
        truth = [f"w{r.randrange(60)}" for _ in range(r.randint(1, 80))]
        seen = [w if r.random() < 0.8 else f"w{r.randrange(60)}" for w in truth if r.random() < 0.9]
        pairs.append((" ".join(seen), " ".join(truth)))
    pairs += [(None, "a b"), ("a", None), ("", ""), (None, None)]
    got = distance.word_error_rate(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, r string"), "p", "r").orderBy("i").collect()
    for row, (p, t) in zip(got, pairs, strict=True):
        p, t = (p or "").split(), (t or "").split()
        assert row.wer == pytest.approx(edits(p, t) / len(t) if t else float(bool(p)))


def test_elements_of_binary_codes(spark):
    raw = [(1, bytes.fromhex("5A03616263") + bytes.fromhex("5F1F0141")), (2, None), (3, b""), (4, bytes.fromhex("5A8102FFFF")), (5, bytes.fromhex("5A05"))]
    got = [(r.k, r.place, r.tag, bytes(r.value)) for r in codecs.tlv_elements(spark.createDataFrame(raw, "k long, d binary"), "k", "d").orderBy("k", "place").collect()]
    assert got == [(1, 0, "5A", b"abc"), (1, 1, "5F1F", b"A"), (4, 0, "5A", b"\xff\xff")]


def test_lanes_are_found(spark, tiny):
    assert catalog.queries()["lane_split"](spark, tiny).count() > 0
    broken = catalog.queries()["hash_chain_verify"](spark, tiny)
    assert broken.where("NOT content_ok").count() > 0 and broken.where("NOT link_ok").count() > 0
