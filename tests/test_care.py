import re

import pytest
from pyspark.sql import functions as F

from clinspark.operators import care

TEXTS = ["Intubated for ARDS", "hypertension", "PE", "COVID with severe pneumonia", "COVID", "TB, MRSA", "hip fracture and CHF", "C. diff", "", None, "ventilation weaned", "landscape", "TBI", "septic shock; on 4L NC", "ICU 1:1", "STEMI", "NSTEMI"]


def of(spark, column, rows=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows or TEXTS)], "i int, t string")
    return {r.t: r.c for r in df.select("t", column.alias("c")).collect()}


def test_outcomes_by_severity_with_all_rules(spark):
    got = of(spark, care.suggestion(care.MOBILITY, F.col("t"), F.lit("bipap")))
    assert (got["Intubated for ARDS"].outcome, got["Intubated for ARDS"].confidence, got["Intubated for ARDS"].conflicting) == ("CRITICAL_TRANSPORT", 0.95, True)
    assert [r.code for r in got["hip fracture and CHF"].rules] == ["MOB_STRETCHER", "MOB_WHEELCHAIR", "MOB_WHEELCHAIR_O2"]
    assert [r.code for r in got["hypertension"].rules] == ["MOB_WHEELCHAIR_O2"] and not got["hypertension"].conflicting
    assert got[None].outcome == "WHEELCHAIR" and got[None].status == "UNVALIDATED"
    iso = of(spark, care.suggestion(care.ISOLATION, F.col("t")))
    assert {t: s.outcome for t, s in iso.items() if s.outcome} == {"COVID with severe pneumonia": "AIRBORNE", "COVID": "DROPLET", "TB, MRSA": "AIRBORNE", "C. diff": "CONTACT"}
    assert (iso["PE"].outcome, iso["PE"].confidence, iso["PE"].rules) == (None, 0.0, [])


@pytest.mark.parametrize("rules", [care.MOBILITY, care.OXYGEN, care.ISOLATION])
def test_patterns_anywhere_against_a_plain_version(spark, rules):
    got = of(spark, care.suggestion(rules, F.col("t"), borders=False))
    for t in TEXTS:
        want = sorted((r for r in rules if r.pattern and re.search(r.pattern, t or "", re.I)), key=lambda r: -r.severity)
        assert [r.code for r in got[t].rules] == [r.code for r in want] and got[t].outcome == (want[0].outcome if want else None)


def test_borders_of_words(spark):
    at = lambda borders: {t for t, hit in of(spark, F.coalesce(F.col("t"), F.lit("")).rlike(care.found_by("PE|CAP|VENTILAT", borders))).items() if hit}
    assert at(True) == {"PE", "ventilation weaned"}
    assert at(False) == {"PE", "ventilation weaned", "hypertension", "landscape"}


def test_acuity_and_levels(spark):
    got = of(spark, care.acuity(F.col("t")))
    assert [(s.signal, s.found) for s in got["septic shock; on 4L NC"].signals] == [("critical_diagnoses", "septic shock"), ("o2_indicators", "on 4L")]
    assert (got["septic shock; on 4L NC"].score, got["STEMI"].triage, got["NSTEMI"].triage, got["ICU 1:1"].score) == (0.9, "RED", "YELLOW", 0.85)
    assert (got["hypertension"].score, got[None].triage, got[""].signals) == (0.0, "GREEN", [])
    kind = of(spark, care.level(F.col("t"), care.LEVELS["oxygen"]))
    assert (kind["Intubated for ARDS"], kind["septic shock; on 4L NC"], kind[None]) == ("VENTILATOR", "NASAL_CANNULA", "NONE")


def test_vital_signs(spark):
    df = spark.createDataFrame([(1, 39, 15), (2, 45, 15), (3, 0, 8), (4, None, 12), (5, 80, None)], "i int, hr int, gcs int")
    got = {r.i: r.a for r in df.select("i", care.acuity(F.lit(""), {"hr": F.col("hr"), "gcs": F.col("gcs")}).alias("a")).collect()}
    assert {i: a.score for i, a in got.items()} == {1: 0.8, 2: 0.5, 3: 0.8, 4: 0.5, 5: 0.0}
    assert [s.signal for s in got[1].signals] == ["critical_vitals", "high_acuity_vitals"]


def test_checks_and_hints(spark):
    rows = [(1, 10, "M", "NSTEMI", None), (2, 130, "M", "endometriosis", None), (3, 50, "F", "prostate ca, ESRD", "Metformin"), (4, 50, "F", "HTN", "insulin, heparin"), (5, 50, "F", "DM2 with PE", "insulin, heparin"), (6, None, None, None, "insulin"), (7, 50, "M", "pericarditis", "heparin")]
    df = spark.createDataFrame(rows, "i int, age int, gender string, dx string, meds string")
    c = [F.col(x) for x in ("age", "gender", "dx", "meds")]
    got = {r.i: r for r in df.select("i", care.checks(*c).alias("w"), care.checks(*c, borders=False).alias("any")).collect()}
    codes = lambda ws: [(w.code, w.term) if w.term else w.code for w in ws]
    assert codes(got[1].w) == [("UNUSUAL_FOR_AGE", "NSTEMI")]
    assert codes(got[1].any) == [("UNUSUAL_FOR_AGE", x) for x in ("NSTEMI", "STEMI", "MI")]
    assert codes(got[2].w) == ["AGE_IMPLAUSIBLE", "DX_NOT_FOR_MALE"] and codes(got[3].w) == ["DX_NOT_FOR_FEMALE", "METFORMIN_KIDNEY"]
    assert codes(got[4].w) == ["INSULIN_WITHOUT_DIABETES", "ANTICOAGULANT_WITHOUT_CAUSE"] and got[5].w == got[6].w == []
    assert codes(got[7].w) == ["ANTICOAGULANT_WITHOUT_CAUSE"] and got[7].any == []
    hint = of(spark, care.triage_hint(F.col("t")), ["NSTEMI", "STEMI", "sepsis", "septic shock", "DM2", "well", None])
    assert hint == {"NSTEMI": "YELLOW", "STEMI": "RED", "sepsis": "YELLOW", "septic shock": "RED", "DM2": "GREEN", "well": None, None: None}
    move = of(spark, care.mobility_hint(F.col("t"), F.lit(None).cast("string")), ["stroke", "COPD", "well", "", None])
    assert move == {"stroke": "STRETCHER", "COPD": "WHEELCHAIR", "well": "AMBULATORY", "": None, None: None}


def test_missing_fields(spark):
    rows = [(1, "Sara Ali", None, None, "stroke", None), (2, "ali Sara", "", "RED", "stroke", None), (3, "Sara", "M", None, None, "Insulin 10u, furosemide"), (4, None, None, None, None, None), (5, "Noor X", None, "", "", "")]
    table = spark.createDataFrame(rows, "id int, name string, gender string, triage string, dx string, meds string")
    names = spark.createDataFrame([("SARA", "F"), ("Ali", "M"), ("noor", "M"), ("noor", "F"), (None, "F")], "name string, gender string")
    drugs = spark.createDataFrame([("insulin", "DM"), ("furosemide", "CHF"), ("furosemide", "HTN"), ("none", "X")], "drug string, disease string")
    got = {r.id: tuple(r)[1:] for r in care.predicted(table, "id", names, drugs).collect()}
    assert got == {
        1: ("F", "YELLOW", "AMBULATORY", "NONE", "NONE", None), 2: ("M", None, None, None, None, None), 3: (None, None, None, None, None, "CHF, DM, HTN"),
        4: (None, None, None, None, None, None), 5: ("F", None, None, None, None, None),
    }
    assert care.predicted(table.limit(0), "id", names, drugs).count() == 0


def test_signals_of_whole_words_as_in_sql(spark, tmp_path):
    import duckdb

    from clinspark.plans import care as plans

    texts = [None, "", "reble onble", "reble onblean hesh", "Reble onble, heti", "edorea", "edoreas heti", "xhesh orer", "onblean", "wedorea", "hesh\nreble onblé", "reble onble2 reble onble"]
    table = f"'{tmp_path}/documents.parquet'"
    duckdb.execute("CREATE OR REPLACE TABLE t (doc_id BIGINT, text VARCHAR)")
    duckdb.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    duckdb.execute(f"COPY t TO {table} (FORMAT parquet)")
    found = duckdb.sql(plans.SQL["acuity_signals"].replace("FROM documents", f"FROM {table}"))
    got = [r.asDict() for r in plans.acuity_signals(spark, str(tmp_path)).collect()]
    want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(got, key=lambda r: r["doc_id"]) == sorted(want, key=lambda r: r["doc_id"])
    assert [r["score"] for r in sorted(got, key=lambda r: r["doc_id"])][2:4] == [0.9, 0.7]
