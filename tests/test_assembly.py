"""Records from clusters of words, against a plain version that reads word by word."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from clinspark.operators import assembly

SCHEMA = "doc_id long, row_id int, i int, entity string, text string, confidence double, x double, w double, h double, cx double, cy double, role string, on_sheet boolean"
KNOWN, CLINICAL = ["sara", "omar"], ["copd", "ward"]
ONES = {"bed": "BED", "triage": "TRIAGE", "allergies": "ALLERGY", "code": "STATUS", "civil_id": "CIVIL_ID", "ward": "WARD", "o2": "O2", "isolation": "ISOLATION", "mobility": "MOBILITY", "blood_type": "BLOOD_TYPE"}


def build(spark, rows):
    arrays = [F.array(*map(F.lit, ws)) for ws in (KNOWN, CLINICAL)]
    return {(r.doc_id, r.row_id): r.asDict() for r in assembly.assemble(spark.createDataFrame(rows, SCHEMA), *arrays).collect()}


def plain(rows, score):
    """rows of one cluster in order -> record or None"""
    words = [dict(zip([c.strip().split()[0] for c in SCHEMA.split(",")], r, strict=True)) for r in sorted(rows, key=lambda r: r[2])]
    out, sure, lists = {}, {}, {k: [] for k in ("NAME", "DIAGNOSIS", "MEDICATION", "ASSIGNED_DOCTOR", "SHEET_STATUS")}
    both = [w for w in words if w["entity"] == "AGE_GENDER"]
    for f, k, read in (("age", "AGE", lambda t: int(re.search(r"\d{1,3}", t)[0])), ("gender", "GENDER", lambda t: re.search("[MFmf]", t)[0].upper())):
        source = both[-1:] or [w for w in words if w["entity"] == k][:1]
        if source:
            out[f], sure[f] = read(source[0]["text"]), source[0]["confidence"]
    if both:
        sure["age_gender"] = both[-1]["confidence"]
    taken = set()
    for t in words:
        if t["entity"] == "DOCTOR_TITLE":
            right = [n for n in words if n["entity"] == "NAME" and n["cx"] > t["cx"] and abs(n["cy"] - t["cy"]) < t["h"] * 1.5]
            if right:
                taken.add(min(right, key=lambda n: (n["cx"], n["i"]))["i"])
    for w in words:
        e = w["entity"]
        if e in lists:
            lists["ASSIGNED_DOCTOR" if w["i"] in taken else e].append(w | {"late": w["i"] in taken})
        for f, k in ONES.items():
            if e == k and (f not in out or w["confidence"] > sure[f]):
                out[f], sure[f] = w["text"].strip(), w["confidence"]
    low, high = min(w["x"] for w in words), max(w["x"] + w["w"] for w in words)
    clinical = [w["x"] for w in words if w["entity"] in assembly.CLINICAL]
    edge = min(clinical) - 10 if clinical else low + max(1.0, high - low) * 0.48
    read_names = bool(lists["NAME"])
    for u in words:
        if u["entity"] != "UNKNOWN":
            continue
        s, late = score[u["text"]], u | {"late": True}
        others = any(lists[k] for k in ("NAME", "DIAGNOSIS", "ASSIGNED_DOCTOR", "SHEET_STATUS"))
        if "bed" not in out and re.fullmatch(r"\d{1,3}(\s*-\s*\d{1,3})?", u["text"]) and u["cx"] <= edge and others:
            out["bed"], sure["bed"] = u["text"], 0.58
            continue
        if s >= 0.72 and u["cx"] <= edge:
            lists["NAME"].append(late | {"confidence": max(s, u["confidence"])})
            read_names = True
            continue
        if s >= 0.76 and read_names and u["cx"] >= low + max(1.0, high - low) * 0.62:
            lists["ASSIGNED_DOCTOR"].append(late | {"confidence": max(s, u["confidence"])})
            continue
        near = {k: min([math.hypot((u["cx"] - n["cx"]) * 0.3, u["cy"] - n["cy"]) for n in words if n["entity"] == k], default=None) for k in ("NAME", "DIAGNOSIS")}
        a, b = near["NAME"], near["DIAGNOSIS"]
        if a is not None and (b is None or a < b) and re.search("[A-Za-z؀-ۿ]", u["text"]):
            lists["NAME"].append(late)
        elif b is not None and re.search(r"[A-Z]{2,}|\d", u["text"]):
            lists["DIAGNOSIS"].append(late)
    for f, k, by in (("name", "NAME", " "), ("dx", "DIAGNOSIS", ", "), ("meds", "MEDICATION", ", "), ("doctor", "ASSIGNED_DOCTOR", " "), ("sheet_status", "SHEET_STATUS", " ")):
        got = sorted(lists[k], key=lambda w: (w["late"], w["i"]))
        if got:
            sure[f] = sum(w["confidence"] for w in got) / len(got)
            arabic = k == "NAME" and re.search("[؀-ۿ]", got[0]["text"])
            if by == " ":
                got = sorted(got, key=lambda w: -w["cx"] if arabic else w["cx"])
            out[f] = by.join(dict.fromkeys(w["text"].strip() for w in got))
    if not {"name", "bed", "dx", "civil_id", "age"} & out.keys():
        return None
    roles, placed, on = {w["role"] for w in words if w["role"]}, sum(w["role"] is not None for w in words), sum(w["on_sheet"] for w in words)
    core = {"NAME", "DIAGNOSIS"} <= roles
    three = core and placed >= 3 and bool({"doctor", "sheet_status"} & out.keys())
    bare = three and not {"bed", "age", "gender", "civil_id"} & out.keys()
    structure = min(1.0, 0.48 * core + 0.08 * min(4, len(roles & set(assembly.SUPPORT))) + 0.035 * min(6, placed) + 0.05 * min(3, on) + 0.07 * three + 0.04 * bare)
    weights = {"name": 3, "bed": 2.5, "age_gender": 2.1, "age": 0.4 if "gender" in out else 1.1, "gender": 0.4 if "age" in out else 1.1, "triage": 0.9, "dx": 1.7, "meds": 1.1, "allergies": 0.7, "code": 0.6, "doctor": 0.35, "sheet_status": 0.3}
    parts = [(sure[f], v) for f, v in weights.items() if f in sure] + [(structure, 1.3)]
    bonus = 0.12 * ("name" in out and "dx" in out and core) + sum(b for f, (k, b) in assembly.ROLE_BONUS.items() if f in out and k in roles) + 0.03 * min(2, on) + 0.05 * (placed >= 3) + 0.06 * three + 0.04 * bare
    out["confidence"] = max(0.0, min(1.0, sum(s * v for s, v in parts) / sum(v for _, v in parts) + min(6, len(words)) / 6 * 0.08 + bonus))
    return out


def word(i, entity, text, at, confidence=0.8, line=0, role=None, on_sheet=False, row=0, doc=1):
    return (doc, row, i, entity, text, confidence, float(at), 40.0, 20.0, at + 20.0, line * 30.0, role, on_sheet)


def test_names_run_with_their_script_and_titles_take_the_name_to_their_right(spark):
    got = build(spark, [word(0, "NAME", "Omar", 50), word(1, "NAME", "Ali", 100), word(2, "DOCTOR_TITLE", "Dr", 300), word(3, "NAME", "Sara", 340), word(0, "NAME", "عمر", 50, row=1), word(1, "NAME", "علي", 100, row=1)])
    assert (got[1, 0]["name"], got[1, 0]["doctor"]) == ("Omar Ali", "Sara") and got[1, 1]["name"] == "علي عمر"


def test_unknown_words_fill_what_is_lacking(spark):
    got = build(spark, [word(0, "UNKNOWN", "12", 0), word(1, "UNKNOWN", "Sara", 60), word(2, "DIAGNOSIS", "COPD", 200), word(3, "UNKNOWN", "GOLD3", 260), word(4, "AGE_GENDER", "44/F", 130)])
    r = got[1, 0]
    assert (r["bed"], r["name"], r["dx"], r["age"], r["gender"]) == ("12", "Sara", "COPD, GOLD3", 44, "F")
    assert build(spark, [word(0, "UNKNOWN", "x", 0), word(1, "TRIAGE", "red", 50)]) == {}
    assert build(spark, []) == {}


def test_random_clusters_equal_the_plain_version(spark):
    r = random.Random(8)
    texts = {"AGE_GENDER": ["44/F", "7M"], "AGE": ["30", "61"], "GENDER": ["M", "F"], "UNKNOWN": ["12", "3-4", "Sara", "omar ali", "GOLD3", "x", "Zed", "%", "سارة علي"], "NAME": ["Sara", "Omar", "Lee", "عمر"]}
    kinds = [*texts, *assembly.CLINICAL, *ONES.values(), "DOCTOR_TITLE"]
    rows = []
    for k in range(400):
        for i in range(r.randint(1, 9)):
            e = r.choice(kinds) if r.random() < 0.5 else r.choice(["NAME", "UNKNOWN", "DIAGNOSIS"])
            rows.append((k % 7, k, i, e, r.choice(texts.get(e, ["AA", "BB", "CC"])), r.choice([0.4, 0.6, 0.9]), float(x := r.randrange(0, 600, 20)), 40.0, 20.0, x + 20.0, r.choice([0.0, 10.0, 45.0]), r.choice([None, None, "NAME", "DIAGNOSIS", "WARD", "ASSIGNED_DOCTOR"]), r.random() < 0.2))
    unknown = spark.createDataFrame([(t,) for t in texts["UNKNOWN"]], "t string")
    score = dict(unknown.select("t", assembly.name_score(F.col("t"), *[F.array(*map(F.lit, ws)) for ws in (KNOWN, CLINICAL)])).collect())
    got = build(spark, rows)
    for k in range(400):
        want = plain([x for x in rows if x[1] == k], score)
        have = got.get((k % 7, k))
        if want is None:
            assert have is None
            continue
        confidence = want.pop("confidence")
        assert {f: v for f, v in have.items() if v is not None and f not in ("doc_id", "row_id", "confidence")} == want, [x for x in rows if x[1] == k]
        assert have["confidence"] == pytest.approx(confidence)


def test_words_are_classified_once_and_read_back(spark, tmp_path):
    """The text is read from its source once, not again for each part of the job; all flags of a sheet may be null."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [word(0, "UNKNOWN", "12", 0), word(1, "UNKNOWN", "Sara", 60), word(2, "DIAGNOSIS", "COPD", 200), word(3, "DOCTOR_TITLE", "Dr", 260), word(4, "NAME", "Omar", 300, on_sheet=None)]
    words = spark.createDataFrame(rows, SCHEMA)
    arrays = [F.array(*map(F.lit, ws)) for ws in (KNOWN, CLINICAL)]
    got = assembly.assemble(words.mapInArrow(count, words.schema), *arrays).collect()
    assert seen.value == len(rows)
    assert [(r["bed"], r["name"], r["dx"], r["doctor"]) for r in got] == [("12", "Sara", "COPD", "Omar")]


def test_verdicts_on_tokens_do_not_depend_on_the_given_upper_case(spark):
    from clinspark.operators.text_rules import entity_scores

    texts = ["", " ", "44/F", "7m", "A-M-1", "ICU 2", "ab", "O+", "o-", "12", "212345678901", "mrn 12345", "Dr. Lee", "Sara", "nkda", "amoxicillin", "9 years", "b12", "bed 4", None]
    t, u = F.col("t"), F.upper(F.trim("t"))
    rows = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("u", u)
    got = {r.t: (r.a, r.b) for r in rows.select("t", entity_scores(t).alias("a"), entity_scores(t, F.col("u")).alias("b")).collect()}
    assert all(a == b for a, b in got.values()) and got[None] == ([], [])
    kinds = {k: [x.entity for x in a] for k, (a, _) in got.items()}
    assert kinds["44/F"] == ["AGE_GENDER"] and kinds["o-"] == kinds["O+"] == ["BLOOD_TYPE"] and kinds["12"] == ["AGE"] and kinds["A-M-1"] == ["BED"] and kinds["212345678901"] == ["CIVIL_ID"]
    assert kinds["b12"] == kinds["bed 4"] == ["BED"] and kinds["9 years"] == ["AGE"] and kinds["mrn 12345"] == ["CIVIL_ID"] and kinds["ICU 2"] == ["WARD"] and kinds["Sara"] == ["NAME"]
