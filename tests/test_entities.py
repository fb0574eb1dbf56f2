"""Entity scorers, normalisers and clinical rules against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from clinspark.functions.scalar import bed_text, key_seed, sheet_label, standard_text
from clinspark.operators import clinical_text as X
from clinspark.operators import entities, text_rules


def values(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [r.v for r in rows.orderBy("i").collect()]


def test_beds_labels_and_text_are_normalised(spark):
    beds = {"r00m 12": "Room 12", "RM5": "Room 5", "bed  3": "Bed 3", "B7": "Bed 7", "icu 4": "ICU-4", "ICU-11": "ICU-11", "a-m-O7": "A-M-07", "401 - 1": "401-1", "4a-12": "4A-12", "corner  bed": "corner bed", "": "", "b3d": "b3d"}
    assert values(spark, bed_text, list(beds)) == list(beds.values())
    labels = {"Patient_Name:": "Patient Name", "Age | Sex": "Age/Sex", "Bed Number": "Bed no", " Dx (main) ": "Dx main", None: ""}
    assert values(spark, sheet_label, list(labels)) == list(labels.values())
    texts = {"h/t , D.M. type 2;CKD 3": "HTN, DM2, CKD3", "a fib and C.O.P.D": "AF and COPD", "pe not PE": "pe not PE", "n/v with abd pain": "Nausea/Vomiting with Abdominal pain", None: ""}
    assert values(spark, standard_text, list(texts)) == list(texts.values())


def test_pattern_scorers(spark):
    want = {
        "e-m-o3": ("BED", 0.99), "Room 12": ("BED", 0.9), "401-1": ("BED", 0.86), "B4": ("BED", 0.9), "ICU-2": ("BED", 0.9), "4A-12": ("BED", 0.84), "67/M": ("AGE_GENDER", 0.95), "f 30": ("AGE_GENDER", 0.95), "200/M": None,
        "45": ("AGE", 0.5), "45 yrs old": ("AGE", 0.9), "F": ("GENDER", 0.6), "Female": ("GENDER", 0.95), "2850l0112345": ("CIVIL_ID", 0.97), "MRN: 123456": ("CIVIL_ID", 0.85), "icu": ("WARD", 0.92), "ward 5": ("WARD", 0.88),
        "RED": ("TRIAGE", 0.98), "GREEM": ("TRIAGE", 0.72 + 0.22 * 0.8), "hfnc 40L": ("O2", 0.95), "room air": ("O2", 0.85), "Contact iso": ("ISOLATION", 0.92), "w/c": ("MOBILITY", 0.92), "Bedridden": ("MOBILITY", 0.85),
        "AB+": ("BLOOD_TYPE", 0.92), "O neg": ("BLOOD_TYPE", 0.9), "DNR": ("STATUS", 1.0), "NFR": ("STATUS", 0.9), "follow-up": ("SHEET_STATUS", 0.76), "to icu": ("SHEET_STATUS", 0.8), "q4h": ("SHEET_STATUS", 0.72), "NKDA": ("ALLERGY", 1.0), "latex": ("ALLERGY", 0.6),
        "Ahmed": ("NAME", 0.48), "AHMED ALI": ("NAME", 0.88), "Al-Mutairi": ("NAME", 0.82), "Dr. Ahmed": ("ASSIGNED_DOCTOR", 0.76 + 0.18 * 0.48), "محمد علي": ("NAME", 0.88), "???": None,
    }
    got = values(spark, lambda t: F.array_max(entities.score(t)), list(want))
    for token, g in zip(want, got, strict=True):
        w = want[token]
        assert (g is None) == (w is None) and (g is None or (g.entity, round(g.confidence, 6)) == (w[0], pytest.approx(w[1]))), (token, g)


def test_lexicons_decide(spark):
    lexicon = lambda *terms: spark.createDataFrame([(t,) for t in terms], "term string")
    tokens = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(["STEMI", "pneumonja", "amoxicilin", "omar", "Pneumonia", "Name", "Dr.", "-", None, "zzz", "septic shock"])], "i int, text string, c double")
    got = {r.i: (r.entity, round(r.entity_confidence, 4), r.corrected) for r in entities.classify(tokens, "text", "c", lexicon("Omar", "Ali"), lexicon("stemi", "pneumonia", "septic shock", "shock"), lexicon("amoxicillin", "aspirin")).collect()}
    assert got[0] == ("DIAGNOSIS", 1.0, "STEMI") and got[1][0] == "DIAGNOSIS" and got[1][2] == "PNEUMONIA"
    assert got[2][0] == "MEDICATION" and got[2][2] == "AMOXICILLIN" and got[3][:1] == ("NAME",) and got[4][0] == "DIAGNOSIS"
    assert got[5][0] == "HEADER" and got[6][0] == "DOCTOR_TITLE" and got[7][0] == got[8][0] == "NOISE" and got[9] == ("UNKNOWN", 0.35, "zzz") and got[10][0] == "DIAGNOSIS"


def test_triage_lists_its_rules(spark):
    got = values(spark, X.suggest_triage, ["stemi, uti", "NSTEMI and STEMI", "STEMI then NSTEMI", "peptic", None, "DM2 with DKA"])
    assert [(g.triage, [r.rule for r in g.rules], g.conflict) for g in got] == [
        ("RED", ["RED_STEMI", "GREEN_UTI"], True), ("RED", ["RED_STEMI", "YELLOW_NSTEMI"], True), ("YELLOW", ["YELLOW_NSTEMI"], False), (None, [], False), (None, [], False), ("RED", ["RED_DKA"], False),
    ]
    assert got[3].confidence == 0 and got[0].status == "UNVALIDATED" and got[0].rules[0].category == "cardiac"


def test_key_seed(spark):
    row = spark.range(1).select(key_seed(F.lit("l898902c"), F.lit("690806"), F.lit("940623")).alias("s")).first()
    assert row.s == "L898902C<369080619406236"


def test_a_sharp_s_is_one_letter(spark):
    rows = [("geenß",), ("ßred",), ("ﬁred",), ("ABPOß",), ("abpos",), ("green",), ("grﬀen",)]
    got = {(r.t, s.entity): round(s.confidence, 9) for r in spark.createDataFrame(rows, "t string").select("t", entities.score(F.col("t")).alias("s")).collect() for s in r.s if s.entity in ("TRIAGE", "BLOOD_TYPE")}
    assert got == {("geenß", "TRIAGE"): 0.896, ("ßred", "TRIAGE"): 0.94, ("ﬁred", "TRIAGE"): 0.94, ("abpos", "BLOOD_TYPE"): 0.9, ("green", "TRIAGE"): 0.98, ("grﬀen", "TRIAGE"): 0.896}


def test_repeated_texts_are_read_once(spark):
    rows = spark.range(60).select("id", F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 < 3 THEN 'septic shock, htn' ELSE concat('uti ', id % 2) END").alias("dx"))
    for table in (rows, rows.where("id IN (3, 4, 5)")):  # the second one's texts all differ
        want = {r.id: r.s for r in table.select("id", X.suggest_triage(F.col("dx")).alias("s")).collect()}
        assert {r.id: r.s for r in X.read_once(table, "dx", X.suggest_triage, "s").collect()} == want
    seen = spark.sparkContext.accumulator(0)

    def counted(t):
        seen.add(1)
        return t

    assert X.read_once(rows, "dx", F.udf(counted, "string").asNondeterministic(), "s").count() == 60
    assert seen.value <= 4


def test_rules_are_matched_once_for_all_fields(spark):
    plan = spark.range(1).select(X.suggest_triage(F.concat(F.lit("uti "), F.col("id").cast("string"))).alias("s")).select("s.triage", "s.confidence", "s.rules", "s.conflict")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RED_STEMI") == 1


def test_the_vault_masks_each_identifier_once(spark):
    docs = spark.createDataFrame([(1, "File: 1234567 a@b.co, 5555 6666; MRN#7654321"), (2, None), (3, "none"), (4, "x 1234 y"), (5, "DOB 1/2/1990 c@d.ef 212345678901")], "d int, t string")
    found = text_rules.vault(docs, "d", "t")
    assert text_rules.mask_steps(docs, "t")._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == len(text_rules.IDENTIFIERS)
    assert sorted((r.d, r.token) for r in found.collect()) == [(1, "[EMAIL_0000]"), (1, "[MRN_0001]"), (1, "[MRN_0002]"), (1, "[PHONE_0003]"), (5, "[CIVIL_ID_0001]"), (5, "[DOB_0002]"), (5, "[EMAIL_0000]")]
