import random

import pytest
from pyspark.sql import functions as F

from clinspark.functions.distance import weighted_distance as plain
from clinspark.operators import fuzzy, weighted
from clinspark.plans import text

COSTS = [("o", "0", 0.1), ("0", "c", 0.4), ("l", "1", 0.05), ("I", "L", 0.2), ("e", "c", 0.6), ("ö", "o", 0.3), ("x", "y", 2.5), ("m", "n", 1.0)]


def table(spark):
    return spark.createDataFrame([*COSTS, ("o", "0", 0.7), ("a", "a", 0.0), ("rn", "m", 0.1), (None, "q", 0.2)], "a string, b string, cost double")


def mapping():
    return {(min(a.lower(), b.lower()), max(a.lower(), b.lower())): c for a, b, c in COSTS}


def words(n, seed, letters="olIe0c1xyöm", low=0, high=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(low, high))) for _ in range(n)})


def test_learned_costs_follow_the_counts(spark):
    seen = spark.createDataFrame([("O", "0", 5), ("0", "o", 5), ("l", "1", 30), ("a", "a", 9), ("é", "e", 1)], "a string, b string, n long")
    base = spark.createDataFrame([("o", "0", 0.3), ("q", "g", 0.4)], "a string, b string, cost double")
    import math

    cost = lambda n, before, trust: before * (1 - trust) + (before * math.exp(-n / 10) + 0.05) * trust
    for corrections, trust in ((9, 0.0), (40, 0.4), (500, 1.0)):
        got = {(r.a, r.b): r.cost for r in weighted.learned_costs(seen, corrections, base).collect()}
        want = {("0", "o"): cost(10, 0.3, trust), ("1", "l"): cost(30, 1.0, trust), ("e", "é"): cost(1, 1.0, trust), ("g", "q"): 0.4}
        if not trust:
            want |= {("0", "o"): 0.3, ("1", "l"): 1.0, ("e", "é"): 1.0}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert weighted.learned_costs(seen.limit(0), 500).count() == 0


def test_band_equals_the_whole_table(spark):
    costs = weighted.Costs.of(table(spark))
    a, b = words(60, 1), words(60, 2)
    pairs = [(x.lower(), y.lower()) for x in a for y in b]
    for limit in (0.0, 0.4, 1.0, 2.3, 9.0):
        got = costs.distances([x for x, _ in pairs], [y for _, y in pairs], limit)
        for (x, y), g in zip(pairs, got, strict=True):
            w = plain(x, y, mapping())
            assert (g == pytest.approx(w)) if w <= limit else g != g, (x, y, limit)


def test_folded_forms_bound_the_distance(spark):
    costs = weighted.Costs.of(table(spark))
    assert costs.classes["0"] == costs.classes["e"] == costs.classes["ö"] and "x" not in costs.classes and "m" not in costs.classes
    rows = spark.createDataFrame([(x, y) for x in words(40, 3) for y in words(40, 4)], "x string, y string")
    for r in rows.select("x", "y", F.levenshtein(costs.fold(F.col("x")), costs.fold(F.col("y"))).alias("d")).collect():
        assert r.d <= plain(r.x, r.y, mapping()) + 1e-9


@pytest.mark.parametrize("limit", [0.5, 1.2, 2.0])
def test_nearest_by_learned_costs_equals_brute_force(spark, limit):
    a, b = words(120, 5), words(150, 6)
    got = {r.t: (r.term, r.distance) for r in weighted.nearest(spark.createDataFrame([(x,) for x in [*a, None, a[3]]], "t string"), "t", spark.createDataFrame([(x,) for x in [*b, None]], "term string"), "term", table(spark), limit).collect()}
    want = {}
    for x in a:
        d, y = min((round(plain(x, y, mapping()), 9), y) for y in b)
        if d <= limit:
            want[x] = (y, pytest.approx(d))
    assert got == want
    assert weighted.nearest(spark.createDataFrame([], "t string"), "t", spark.createDataFrame([], "term string"), "term", table(spark).limit(0), limit).count() == 0


def test_segments_find_all_pairs(spark):
    r = random.Random(8)
    base = ["common#prefix" + "".join(r.choice("0123") for _ in range(4)) for _ in range(40)] + words(60, 9, "ab", 0, 6) + ["z" * 150 + "abc", "z" * 149 + "abd", "é" * 140]
    left = sorted({*base[::2], *(x[:k] + x[k + 1 :] for x in base for k in [r.randint(0, len(x))]), *(x + "q" for x in base)})
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    for k in (0, 1, 2, 3):
        got = {(p.t, p.u, p.distance) for p in fuzzy.segment_pairs(frame(left, "t"), "t", frame(base, "u"), "u", k).collect()}
        want = {(p.t, p.u, p.distance) for p in frame(left, "t").crossJoin(frame(sorted(set(base)), "u")).withColumn("distance", F.levenshtein("t", "u")).where(F.col("distance") <= k).collect()}
        assert got == want


def test_cuts_even_out_what_places_tell():
    assert fuzzy.balanced_cuts([0.01] * 6 + [3.0, 3.0, 3.0], 3) == [0, 7, 8]
    assert fuzzy.balanced_cuts([1.0] * 6, 3) == [0, 2, 4]
    assert fuzzy.balanced_cuts([9.0, 0.1, 0.1], 3) == [0, 1, 2]


def test_learned_match_of_the_tables(spark, tiny):
    rows = text.learned_distance_match(spark, tiny).collect()
    changed = [r for r in rows if r.seen != r.truth]
    assert len(changed) > 50 and sum(r.term == r.truth for r in changed) > 0.9 * len(changed)
    assert all(r.dist == 0 for r in rows if r.seen == r.truth)


def test_confusable_costs_are_the_ocr_distance():
    costs = weighted.Costs(weighted.confusable_costs())
    for x in words(40, 11, "oq0DIl1|zs5b8at7"):
        for y in words(20, 12, "oq0DIl1|zs5b8at7"):
            assert costs.distances([x.lower()], [y.lower()], 9.0)[0] == pytest.approx(plain(x, y))


def test_tokens_of_strange_letters_leave_early_and_lose_nothing(spark, monkeypatch):
    left = ["suppOOO12", "suppO12", "sOppl1", "😀upp12", "SUPP012", "zzzzzzz", "supp0129", "sppO12"]
    right = ["supp012", "supp00012", "suppl1", "s😀pp12", "supp12"]
    costs = spark.createDataFrame(weighted.confusable_costs(), "a string, b string, cost double")
    asked, pairs = {}, fuzzy.segment_pairs

    def counted(l, t, r, u, e):
        asked[e] = l.count()
        return pairs(l, t, r, u, e)

    monkeypatch.setattr(fuzzy, "segment_pairs", counted)
    got = {r.t: (r.term, round(r.distance, 6)) for r in weighted.nearest(spark.createDataFrame([(x,) for x in left], "t string"), "t", spark.createDataFrame([(x,) for x in right], "term string"), "term", costs, 2.0).collect()}
    table = {(a, b): c for a, b, c in weighted.confusable_costs()}
    want = {}
    for x in left:
        d, t = min((plain(x, y, table), y) for y in right)
        if d <= 2.0:
            want[x] = (t, round(d, 6))
    assert got == want
    assert asked[0] == 8 and asked.get(2, 0) <= 2
