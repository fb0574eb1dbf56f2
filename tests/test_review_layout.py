import pandas as pd
from pyspark.sql import functions as F

from clinspark.operators import correction, layout, review
from clinspark.sources import codecs, store


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_suggestions_stay_apart_from_facts(spark):
    s, none = one(spark, review.suggest(F.lit("Intubated, walking"), review.MOBILITY_RULES), review.suggest(F.lit("all well"), review.MOBILITY_RULES))
    assert (s.outcome, s.status) == ("CRITICAL_TRANSPORT", "UNVALIDATED") and none is None


def test_whole_words_only(spark):
    checks = review.cross_checks(F.lit(10), F.lit("M"), F.lit("nstemi"), F.lit(None).cast("string"))
    (w,) = one(spark, checks)
    assert [x.code for x in w] == ["UNUSUAL_FOR_AGE"]
    (w,) = one(spark, review.cross_checks(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("pe"), F.lit("Heparin")))
    assert w == []


def test_review_levels(spark):
    none = F.array().cast("array<struct<field:string,severity:string,code:string>>")
    alert = F.array(F.struct(F.lit("meds").alias("field"), F.lit("CLINICAL_ALERT").alias("severity"), F.lit("X").alias("code")))
    text = F.array().cast("array<string>")
    level = lambda n, c, r, w: review.review_level(F.lit(n), F.lit(c), r, w)
    assert one(spark, level(2, 0.9, text, none), level(2, 0.9, F.array(F.lit("r")), none), level(0, 0.9, text, none), level(3, 0.4, text, none), level(3, 0.99, text, alert)) == ("READY", "REVIEW", "VERIFY", "VERIFY", "VERIFY")


def test_import_needs_every_condition(spark):
    r = review.readiness([("SCHEMA_INVALID", F.lit(False)), ("IDENTIFIER_REQUIRED", F.lit(None).cast("boolean")), ("FLAGS", F.lit(True))])
    assert one(spark, r["blockers"], r["ready"]) == (["IDENTIFIER_REQUIRED", "FLAGS"], False)
    v = review.verdict({"cer": F.lit(0.005), "det": F.lit(None).cast("double")}, {"cer": ("max", 0.01), "det": ("min", 0.95)}, F.lit(False))
    assert one(spark, v["failed"], v["medical_grade"]) == (["det"], False)
    v = review.verdict({"cer": F.lit(0.005)}, {"cer": ("max", 0.01)}, F.lit(True))
    assert one(spark, v["medical_grade"]) == (False,)


def test_relabelling_reads_what_it_has_written():
    rows = pd.DataFrame({"text": ["B1", "Omar", "Hadi", "x1", "40/M", "zz"], "entity": ["BED", "UNKNOWN", "UNKNOWN", "UNKNOWN", "AGE_GENDER", "UNKNOWN"], "confidence": [0.9] + [0.1] * 3 + [0.9, 0.1], "cx": range(6)})
    out = layout.relabel(rows)
    assert out["entity"].tolist() == ["BED", "NAME", "NAME", "UNKNOWN", "AGE_GENDER", "UNKNOWN"]
    assert out["confidence"].tolist() == [0.9, 0.55, 0.52, 0.1, 0.9, 0.1]
    weak = pd.DataFrame({"text": ["STEMI", "Foo"], "entity": ["DIAGNOSIS", "NAME"], "confidence": [0.9, 0.5], "cx": [0, 1]})
    assert layout.relabel(weak)["entity"].tolist() == ["DIAGNOSIS", "DIAGNOSIS"]


def test_parts_share_a_box(spark):
    rows = spark.createDataFrame([("d", "ab | cde", 10.0, 0.0, 80.0, 9.0, 50.0)], "doc_id string, text string, x double, y double, w double, h double, cx double")
    got = [(r.text, r.x, r.w) for r in layout.split_detections(rows).orderBy("part").collect()]
    assert got == [("ab", 10.0, 20.0), ("cde", 40.0, 30.0)]


def test_nearest_anchor_weighs_rows_over_columns(spark):
    words = spark.createDataFrame([("d", 1, 0.0, 0.0)], "doc_id string, word_id int, cx double, cy double")
    anchors = spark.createDataFrame([("d", "far right", 100.0, 0.0), ("d", "below", 0.0, 40.0)], "doc_id string, anchor string, cx double, cy double")
    assert layout.nearest_anchor(words, anchors).first().anchor == "far right"


def test_correction(spark):
    got = one(spark, correction.correct_text(F.lit("ARNODARONE 200mg PO dally, k/c/o DM2")), correction.correct_text(F.lit("Hb 7.2 WBC 22.5 Plt 45")), correction.degarble(F.lit("a1cohol"), F.array(F.lit("alcohol"))), correction.degarble(F.lit("xyz"), F.array(F.lit("alcohol"))))
    assert got == ("AMIODARONE 200mg PO daily, known case of DM2", "Hb 7.2 WBC 22.5 Plt 45", "alcohol", None)
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, correction.coverage(a("aspirin", "metformin"), a("asprin", "metformin")), correction.coverage(a("x"), a("aspirin"))) == (True, False)


def test_tlv_and_machine_readable_lines(spark):
    assert list(codecs.read_tlv(bytes.fromhex("5A020102" + "5F1F0141" + "7F4E8103AABBCC" + "04"))) == [("5A", b"\x01\x02"), ("5F1F", b"A"), ("7F4E", b"\xaa\xbb\xcc")]
    assert list(codecs.read_tlv(b"\x04\x05\x01")) == []
    text = "noise\nI<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON««ANNA<MARIA<<<<<<<<<<"
    (lines,) = one(spark, codecs.mrz_lines(F.lit(text)))
    assert lines == ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]


def test_readings_are_dealt_by_their_number_and_sorted_once(spark):
    h = spark.range(5000).select((F.col("id") % 900).alias("d"), (F.col("id") % 4).cast("string").alias("kind"), (F.col("id") % 7 / 10.0).alias("score"), (F.col("id") % 3).alias("n"))
    best = review.best_hypothesis(h, "d", "kind", "score", "n", ["1"])
    assert best._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert best.count() == 900
    assert store.dealt(h, "d", most=500).rdd.getNumPartitions() == 10
