import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinspark.functions import clinical as C
from clinspark.functions import distance as D
from clinspark.functions import scalar as S
from clinspark.operators import text_rules


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_rounding_goes_half_up(spark):
    assert one(spark, S.js_round(F.lit(-2.5)), S.js_round(F.lit(2.5)), S.js_round(F.lit(22.857), 1)) == (-2, 3, 22.9)


def test_formulas(spark):
    assert one(spark, C.mean_arterial_pressure(F.lit(120), F.lit(80)), C.anion_gap(F.lit(140), F.lit(104), F.lit(24)), C.bmi(F.lit(70), F.lit(175))) == (93, 12, 22.9)
    assert one(spark, C.option_sum(F.lit("4 - spontaneous"), F.lit("5 oriented"), F.lit("no number"))) == (9,)
    assert one(spark, C.ckd_epi_2021(F.lit(50), F.lit(1.0), F.lit(False))) == (92,)


def test_keys(spark):
    got = one(spark, S.bed_key(F.lit("o 1l")), S.civil_id_key(F.lit("2-9O l")), S.name_key(F.lit("Ahmed  Al-1i")), S.normalize_arabic(F.lit("أَحمدة")), S.missing_to_null(F.lit("  ")))
    assert got == ("011", "2901", "AHMED ALI", "احمده", None)
    assert one(spark, S.fix_digraphs(F.lit("arnox")), S.preserve_case(F.lit("ABC"), F.lit("xyz")), S.preserve_case(F.lit("Abc"), F.lit("XYZ"))) == ("amox", "XYZ", "Xyz")
    assert one(spark, S.phrase_tokens(F.lit("(DM2), HTN / x."))) == (["DM2", "HTN", "x"],)


def test_error_rates(spark):
    assert one(spark, S.cer(F.lit("abc"), F.lit("abc")), S.cer(F.lit("xyz"), F.lit("abc")), S.cer(F.lit("a"), F.lit("")), S.cer(F.lit(None).cast("string"), F.lit(""))) == (0.0, 1.0, 1.0, 0.0)
    rows = spark.createDataFrame([("a b c", "a x c"), ("", ""), ("a", None), ("the  Cat", "the cat")], "p string, r string")
    assert [round(r.wer, 3) for r in D.word_error_rate(rows, "p", "r").collect()] == [0.333, 0.0, 1.0, 0.0]


def test_codes(spark):
    assert one(spark, S.mrz_check_digit(F.lit("D23145890")), S.mrz_check_digit(F.lit("<<<"))) == (7, 0)
    born, bad = one(spark, S.civil_id_birth(F.lit("290063000000")), S.civil_id_birth(F.lit("290023100000")))
    assert str(born) == "1990-06-30" and bad is None
    lines = ("I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<")
    td1 = S.parse_td1(*map(F.lit, lines))
    got = dict(zip(td1, one(spark, *td1.values()), strict=True))
    assert (got["document_number"], got["surname"], got["given_names"], str(got["birth"])) == ("D23145890", "ERIKSSON", "ANNA MARIA", "1974-08-12")
    assert got["number_ok"] and got["birth_ok"] and got["expiry_ok"] and got["composite_ok"]


@pytest.mark.parametrize(("text", "outcome"), [("STEMI", "RED"), ("NSTEMI", "YELLOW"), ("UTI", "GREEN"), ("", None), (None, None), ("PE01", None), ("stable PE", "YELLOW")])
def test_triage_rules(spark, text, outcome):
    assert one(spark, text_rules.apply_rules(F.lit(text).cast("string"))["outcome"]) == (outcome,)


def test_unknown_is_not_negative(spark):
    assert one(spark, text_rules.apply_rules(F.lit("nothing known"))["rule"], text_rules.apply_rules(F.lit("uti and pe"))["conflict"]) == (None, True)


words = st.text("abOQ01Il5Ssz", max_size=8)


@given(words, words)
@settings(max_examples=200, deadline=None)
def test_distance_is_symmetric_and_zero_for_equals(a, b):
    assert D.weighted_distance(a, a) == 0
    assert D.weighted_distance(a, b) == pytest.approx(D.weighted_distance(b, a))


def test_native_bound_never_exceeds_the_distance(spark):
    import random

    random.seed(1)
    pairs = [tuple("".join(random.choice("abOQ01Il5Ssz") for _ in range(random.randint(0, 8))) for _ in range(2)) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(D.lower_bound(F.col("a"), F.col("b")).alias("low"), D.ocr_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.low <= r.d + 1e-9 for r in rows)


def test_costs_are_learned_in_both_directions():
    assert D.learned_costs({("a", "b"): 5}) == {}
    costs = D.learned_costs({("B", "a"): 60, ("a", "b"): 40})
    assert costs == {("a", "b"): pytest.approx(0.0500454, abs=1e-6)}
    assert D.weighted_distance("ax", "bx", costs) == D.weighted_distance("bx", "ax", costs)
