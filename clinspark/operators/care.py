"""What a record's texts suggest of its care: rules with all that matched, acuity by signals, checks of fields, missing fields.

Rules are parameters. Patterns ignore case. With ``borders`` (on unless said otherwise) what is found starts at the start of
a word, and ends at its end or is a stem of five letters or more; without, patterns are found anywhere, as "pe" in
"hypertension". Suggestions stay apart from facts: nothing matched is "not assessed" (null), never "none".
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.operators.correction import infer_by_contains


class CareRule(NamedTuple):
    """A pattern of the diagnosis, or values of the oxygen support, that suggest an outcome; higher severity goes first."""

    code: str
    outcome: str
    severity: int
    confidence: float
    pattern: str | None = None
    support: tuple[str, ...] = ()


class Signal(NamedTuple):
    """Patterns of one weight; the first that is found is reported."""

    name: str
    weight: float
    patterns: tuple[str, ...]


# Codes, patterns, outcomes and confidences that results must agree with.
MOBILITY = (
    CareRule("MOB_CRITICAL", "CRITICAL_TRANSPORT", 3, 0.95, "VENTILAT|INTUBAT|ARDS|CARDIAC ARREST|ETT"),
    CareRule("MOB_CRITICAL_O2", "CRITICAL_TRANSPORT", 3, 0.95, support=("VENTILATOR",)),
    CareRule("MOB_STRETCHER", "STRETCHER", 2, 0.88, "CVA|STROKE|SAH|ICH|FRACTURE|GBS|NOF|SDH|EDH|POST.?OP|PARAPL|QUADRI"),
    CareRule("MOB_WHEELCHAIR", "WHEELCHAIR", 1, 0.80, "CHF|ADHF|PE|COPD|AECOPD|CAP"),
    CareRule("MOB_WHEELCHAIR_O2", "WHEELCHAIR", 1, 0.85, support=("BIPAP", "NON_REBREATHER")),
)
OXYGEN = (
    CareRule("O2_VENT", "VENTILATOR", 4, 0.95, "VENTILAT|INTUBAT|ARDS|ETT"),
    CareRule("O2_BIPAP", "BIPAP", 3, 0.88, "BIPAP|CPAP|NIV|TYPE 2 RF"),
    CareRule("O2_NRB", "NON_REBREATHER", 2, 0.82, "SEVERE.*PNEUMONIA|ARDS|RESP(?:IRATORY)? FAILURE"),
    CareRule("O2_NASAL", "NASAL_CANNULA", 0, 0.72, "CAP|AECOPD|CHF|ADHF|SEPSIS|PNEUMONIA"),
)
ISOLATION = (
    CareRule("ISO_AIRBORNE", "AIRBORNE", 3, 0.90, r"\bTB\b|TUBERCULOSIS|COVID.*PNEUMONIA|MEASLES|VARICELLA"),
    CareRule("ISO_DROPLET", "DROPLET", 2, 0.85, "INFLUENZA|COVID(?!.*PNEUMONIA)|MENINGOCOCCAL"),
    CareRule("ISO_CONTACT", "CONTACT", 1, 0.88, r"MRSA|VRE|ESBL|CRE|CDI|C\.?\s*DIFF"),
)
SIGNALS = (
    Signal("critical_diagnoses", 0.9, (
        "cardiac arrest|code blue|PEA|asystole|V-?fib|pulseless", "STEMI|massive PE|tension pneumo|aortic dissection",
        "septic shock|cardiogenic shock|hemorrhagic shock", "status epilepticus|brain death|herniation", "DKA|HHS|thyroid storm|adrenal crisis",
        "GI bleed.*massive|massive hemoptysis", "acute liver failure|fulminant", "intubat|ventilat|ECMO|vasopressor|pressor")),
    Signal("high_acuity_diagnoses", 0.7, (
        "NSTEMI|unstable angina|ACS|acute MI|acute coronary", "PE|DVT|pulmonary embol", "stroke|CVA|TIA|ICH|SAH", "sepsis|bacteremia|severe infection",
        "ARDS|respiratory failure|respiratory distress", "AKI|acute kidney|acute renal", "GI bleed|UGIB|LGIB|hematemesis|melena",
        "pancreatitis|cholangitis|SBO|bowel obstruction", "meningitis|encephalitis", "DKA|diabetic ketoacidosis", "overdose|poisoning|ingestion", "acute abdomen|peritonitis")),
    Signal("icu_indicators", 0.85, (
        "ICU|intensive care|critical care|HDU|step-?down", "ventilator|intubated|ETT|tracheostomy|ECMO", "vasopressor|noradrenaline|norepinephrine|dopamine.*drip|dobutamine",
        "CRRT|continuous.*dialysis|CVVHD", "arterial line|central line|swan.?ganz|PA catheter", "1:1|one.?to.?one|continuous monitor")),
    Signal("o2_indicators", 0.4, (r"on\s+\d+L|nasal cannula|NC|face mask|NRB|non-?rebreather", "BiPAP|CPAP|HFNC|high.?flow", r"FiO2\s*(?:[4-9]\d|100)")),
    Signal("mobility_indicators", 0.3, ("bedbound|bed.?bound|immobile|paralyz|paraplegia|quadriplegia", "stretcher|critical.?transport|non-?ambulat")),
)
#: Below the first or above the second number; a coma score is a whole number, so 8 and 12 are below these.
VITALS = (
    ("critical_vitals", 0.8, (("hr", 40, 150), ("sbp", 80, None), ("spo2", 88, None), ("rr", 8, 35), ("gcs", 8.5, None), ("temp", 35, 40))),
    ("high_acuity_vitals", 0.5, (("hr", 50, 120), ("sbp", 90, 180), ("spo2", 92, None), ("rr", 10, 25), ("gcs", 12.5, None))),
)
#: For each kind: what holds if no pattern is found, and the patterns in the order they are tried.
LEVELS = {
    "mobility": ("AMBULATORY", (("CRITICAL_TRANSPORT", "ventilat|intubat|ECMO|vasopressor|critical.?transport"), ("STRETCHER", "stretcher|bedbound|immobile|bed.?bound|paralyz"), ("WHEELCHAIR", "wheelchair|W/C|unable.*ambul"))),
    "oxygen": ("NONE", (("VENTILATOR", "ventilat|intubat|ETT|ECMO"), ("BIPAP", "BiPAP|CPAP|NIV|NIPPV"), ("NON_REBREATHER", "NRB|non.?rebreather|15L|10L"), ("FACE_MASK", "face.?mask|FM|Hudson|Venturi"), ("NASAL_CANNULA", r"nasal.?cannula|NC|\d+L\s*NC|\bon\s+\d+L\b"), ("NON_REBREATHER", "HFNC|high.?flow"))),
    "isolation": ("NONE", (("AIRBORNE", r"airborne|AFB|TB(?:\s|$)|COVID|SARS|N95"), ("DROPLET", "droplet|influenza|meningococcal"), ("CONTACT", r"contact|MRSA|VRE|C\.?\s*diff|ESBL|CRE|MDR"))),
}
UNUSUAL_UNDER_18 = ("NSTEMI", "STEMI", "MI", "CAD", "AF", "COPD", "AAA")
TRIAGE_HINTS = {
    "YELLOW": r"\bNSTEMI\b|ACS|PE(?![A-Z])|DVT|AKI|ADHF|CHF|CAP(?!\w)|HAP|AECOPD|UGIB|SEPSIS(?!\s*SHOCK)|SBO",
    "RED": r"\bSTEMI\b(?!.*\bNSTEMI\b)|CARDIAC ARREST|STATUS EPILEPT|ARDS|SEPTIC SHOCK|DKA|CVA|SAH|\bVF\b|OVERDOSE|\bOD\b|ECLAMPSIA|DIC|PPH|VARICES|CHOLANGITIS|MENINGITIS|BACTEREMIA|HEMOPTYSIS|RESP FAILURE",
    "GREEN": "UTI|CELLULITIS|HTN|DM[12]?$|CKD[1-3]|COPD$|GORD|ASTHMA|OSA|ANEMIA|IDA|EPILEPSY|HERNIA|PARKINSON|DEMENTIA",
}
MOBILITY_HINTS = (
    ("CRITICAL_TRANSPORT", "VENTILAT|INTUBAT|ARDS|CARDIAC ARREST|ICU|ETT", ("VENTILATOR",)),
    ("STRETCHER", "CVA|STROKE|SAH|ICH|FRACTURE|GBS|NOF|SDH|EDH|POST.?OP|PARAPL|QUADRI", ()),
    ("WHEELCHAIR", "CHF|ADHF|PE|COPD|AECOPD|CAP|O2", ("BIPAP", "NON_REBREATHER")),
)
# End of the fixed values.


def found_by(pattern: str, borders: bool = True, stems: bool = True) -> str:
    """A pattern for rlike: case ignored; with borders at a word's start, up to its end or, with ``stems``, as a stem of five letters or more."""
    end = "(?![\\p{L}\\p{Nd}])"
    inside = "(?<![\\p{L}\\p{Nd}])(?:" + pattern + ")" + (f"(?:{end}|(?<=[\\p{{L}}\\p{{Nd}}]{{5}}))" if stems else end)
    return "(?i)" + (inside if borders else f"(?:{pattern})")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used: patterns over long texts cost most."""
    return F.get(F.transform(F.array(value), use), 0)


def suggestion(rules: Sequence[CareRule], dx: Column, support: Column | None = None, borders: bool = True) -> Column:
    """struct<outcome, confidence, status, conflicting, rules>: the most serious match, ties to the earlier rule.

    rules lists all that matched in that order (code, outcome, confidence). Nothing matched: outcome null, confidence 0, no
    rules. A suggestion is always UNVALIDATED. Null texts and null support match nothing.
    """
    given = F.upper(_text(F.lit(None).cast("string") if support is None else support))
    hits = []
    for i, r in enumerate(rules):
        hit = F.lit(False) if r.pattern is None else _text(dx).rlike(found_by(r.pattern, borders))
        hit = hit | given.isin(list(r.support)) if r.support else hit
        hits.append(F.when(hit, F.struct(F.lit(-r.severity).alias("s"), F.lit(i).alias("i"), F.lit(r.code).alias("code"), F.lit(r.outcome).alias("outcome"), F.lit(r.confidence).alias("confidence"))))
    return _once(
        F.array_sort(F.array_compact(F.array(*hits))),
        lambda ordered: F.struct(
            F.get(ordered, 0)["outcome"].alias("outcome"),
            F.coalesce(F.get(ordered, 0)["confidence"], F.lit(0.0)).alias("confidence"),
            F.lit("UNVALIDATED").alias("status"),
            (F.size(F.array_distinct(F.transform(ordered, lambda h: h["outcome"]))) > 1).alias("conflicting"),
            F.transform(ordered, lambda h: F.struct(h["code"].alias("code"), h["outcome"].alias("outcome"), h["confidence"].alias("confidence"))).alias("rules"),
        ),
    )


def acuity(text: Column, vitals: Mapping[str, Column] | None = None, signals: Sequence[Signal] = SIGNALS, checks=VITALS, borders: bool = True, stems: bool = True) -> Column:
    """struct<score, triage, signals>: the greatest weight of what speaks; 0.8 and more is RED, 0.5 and more YELLOW, else GREEN.

    signals is array<struct<signal, weight, found>>, texts first, then vital signs (found null). A vital sign that is null
    or zero wasn't taken and says nothing. Without ``stems`` what is found ends with its word.
    """
    t, spoken = _text(text), []
    for s in signals:
        found = F.coalesce(*[F.when(t.rlike(found_by(p, borders, stems)), F.regexp_extract(t, found_by(p, borders, stems), 0)) for p in s.patterns])
        spoken.append(F.struct(F.lit(s.name).alias("signal"), F.lit(s.weight).alias("weight"), found.alias("found"), F.lit(True).alias("text")))
    for name, weight, bounds in checks:
        bad = F.lit(False)
        for vital, low, high in bounds:
            if vitals and vital in vitals:
                v = vitals[vital]
                out = (F.lit(False) if low is None else v < low) | (F.lit(False) if high is None else v > high)
                bad = bad | F.coalesce((v != 0) & out, F.lit(False))
        spoken.append(F.when(bad, F.struct(F.lit(name).alias("signal"), F.lit(weight).alias("weight"), F.lit(None).cast("string").alias("found"), F.lit(False).alias("text"))))

    def result(heard: Column) -> Column:
        score = F.coalesce(F.array_max(F.transform(heard, lambda s: s["weight"])), F.lit(0.0))
        told = F.transform(heard, lambda s: F.struct(s["signal"].alias("signal"), s["weight"].alias("weight"), s["found"].alias("found")))
        return F.struct(score.alias("score"), F.when(score >= 0.8, "RED").when(score >= 0.5, "YELLOW").otherwise("GREEN").alias("triage"), told.alias("signals"))

    return _once(F.filter(F.array(*spoken), lambda s: s.isNotNull() & (~s["text"] | s["found"].isNotNull())), result)


def level(text: Column, kind: tuple[str, Sequence[tuple[str, str]]], borders: bool = True) -> Column:
    """The first outcome whose pattern is found, else what holds for texts that say nothing (an entry of ``LEVELS``)."""
    nothing, patterns = kind
    return F.coalesce(*[F.when(_text(text).rlike(found_by(p, borders)), o) for o, p in patterns], F.lit(nothing))


def checks(age: Column, gender: Column, dx: Column, meds: Column, borders: bool = True) -> Column:
    """array<struct<field, severity, code, term>> of what doesn't go together, each once; null fields say nothing."""
    d, m = _text(dx), _text(meds)
    has = lambda c, p: c.rlike(found_by(p, borders))
    rules = [("age", "ERROR", "AGE_IMPLAUSIBLE", None, (age < 0) | (age > 120))]
    rules += [("diagnosis", "WARN", "UNUSUAL_FOR_AGE", x, (age < 18) & (has(d, x) if borders else F.contains(d, F.lit(x)))) for x in UNUSUAL_UNDER_18]
    rules += [
        ("gender", "ERROR", "DX_NOT_FOR_MALE", None, (gender == "M") & has(d, "ovarian|ectopic pregnancy|endometri")),
        ("gender", "ERROR", "DX_NOT_FOR_FEMALE", None, (gender == "F") & has(d, "prostate|testicular")),
        ("medications", "CLINICAL_ALERT", "METFORMIN_KIDNEY", None, has(m, "METFORMIN") & has(d, "CKD5|ESRD")),
        ("diagnosis", "WARN", "INSULIN_WITHOUT_DIABETES", None, (d != "") & has(m, "INSULIN|GLARGINE|ASPART|LISPRO") & ~has(d, "DM[12]?|DIABET|DKA|HHS")),
        ("diagnosis", "WARN", "ANTICOAGULANT_WITHOUT_CAUSE", None, (d != "") & has(m, "HEPARIN|ENOXAPARIN") & ~has(d, "DVT|PE|ACS|NSTEMI|STEMI|AF|VTE")),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"), F.lit(k).alias("code"), F.lit(x).cast("string").alias("term"))) for f, s, k, x, c in rules])))


def triage_hint(dx: Column, borders: bool = True) -> Column:
    """RED goes before YELLOW, YELLOW before GREEN; null where the diagnosis is missing or says nothing."""
    return F.coalesce(*[F.when(F.upper(_text(dx)).rlike(found_by(TRIAGE_HINTS[t], borders)), t) for t in ("RED", "YELLOW", "GREEN")])


def mobility_hint(dx: Column, support: Column, borders: bool = True) -> Column:
    """How a patient is moved, by diagnosis or oxygen support; AMBULATORY where they say nothing, null where both are missing."""
    d, o = _text(dx), F.upper(_text(support))
    hints = [F.when(d.rlike(found_by(p, borders)) | o.isin(list(given)), h) for h, p, given in MOBILITY_HINTS]
    return F.when((d != "") | (o != ""), F.coalesce(*hints, F.lit("AMBULATORY")))


def predicted(table: DataFrame, key: str, names: DataFrame, drugs: DataFrame, borders: bool = True) -> DataFrame:
    """key and what a record lacks: gender, triage, mobility, oxygen, isolation, dx; null where the record has it or nothing tells.

    table: key (unique), name, gender, triage, dx, meds. names: name, gender (first names of any number, joined; a name of both
    is F). drugs: drug, disease. Gender comes from the first word of the name, triage and care from the diagnosis, the
    diagnosis (sorted, joined by commas) from drugs that the medication holds.
    """
    blank = lambda c: F.length(_text(F.col(c))) == 0
    known = names.where("name IS NOT NULL AND gender IN ('F', 'M')").groupBy(F.lower("name").alias("__first")).agg(F.min("gender").alias("__gender"))
    told = infer_by_contains(table.where(blank("dx") & ~blank("meds")), key, "meds", drugs, "drug", "disease").select(key, F.array_join("outcomes", ", ").alias("__dx"))
    rows = table.withColumn("__first", F.lower(F.element_at(F.split(F.ltrim(_text(F.col("name"))), "\\s+"), 1))).join(known, "__first", "left").join(told, key, "left")
    due, text = blank("triage") & ~blank("dx"), F.concat_ws(" ", "dx", "meds")
    care = [F.when(due, level(text, LEVELS[k], borders)).alias(k) for k in ("mobility", "oxygen", "isolation")]
    return rows.select(key, F.when(blank("gender"), F.col("__gender")).alias("gender"), F.when(due, acuity(text, borders=borders)["triage"]).alias("triage"), *care, F.col("__dx").alias("dx"))
