"""Clinical calculators as column expressions, with their interpretation bands, unit conversion and equivalences.

All rounding is half-up (:func:`clinspark.functions.scalar.js_round`). Published formulas; results are doubles or long.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinspark.functions.scalar import js_round


def _points(*terms: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for condition, points in terms:
        total = total + F.when(condition, points).otherwise(0)
    return total


def band(value: Column, *cuts: tuple[float, str], top: str) -> Column:
    """The label of the first cut that the value is below, else ``top``; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, label in cuts:
        out = out.when(value < limit, label)
    return out.otherwise(top)


def mean_arterial_pressure(systolic: Column, diastolic: Column) -> Column:
    return js_round((systolic + 2 * diastolic) / 3)


def anion_gap(na: Column, cl: Column, hco3: Column) -> Column:
    return na - cl - hco3


def corrected_calcium(calcium: Column, albumin: Column) -> Column:
    return js_round(calcium + 0.8 * (4 - albumin), 1)


def corrected_sodium(na: Column, glucose: Column) -> Column:
    return js_round(na + 1.6 * (glucose - 100) / 100, 1)


def bmi(kg: Column, cm: Column) -> Column:
    return js_round(kg / F.pow(cm / 100, F.lit(2.0)), 1)


def bsa(kg: Column, cm: Column) -> Column:
    """Mosteller."""
    return js_round(F.sqrt(kg * cm / 3600), 2)


def aa_gradient(fio2: Column, pao2: Column, paco2: Column) -> Column:
    return js_round(fio2 * (760 - 47) - paco2 / 0.8 - pao2)


def cockcroft_gault(age: Column, kg: Column, creatinine: Column, female: Column) -> Column:
    base = (140 - age) * kg / (72 * creatinine)
    return js_round(base * F.when(female, 0.85).otherwise(1.0))


def ckd_epi_2021(age: Column, creatinine: Column, female: Column) -> Column:
    k = F.when(female, 0.7).otherwise(0.9)
    a = F.when(female, -0.241).otherwise(-0.302)
    r = creatinine / k
    low, high = F.pow(F.least(r, F.lit(1.0)), a), F.pow(F.greatest(r, F.lit(1.0)), F.lit(-1.2))
    return js_round(142 * low * high * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0))


def cha2ds2_vasc(age: Column, female: Column, chf: Column, htn: Column, dm: Column, stroke: Column, vascular: Column) -> Column:
    return _points((age >= 75, 2), ((age >= 65) & (age < 75), 1), (female, 1), (chf, 1), (htn, 1), (dm, 1), (stroke, 2), (vascular, 1))


def has_bled(htn: Column, renal: Column, liver: Column, stroke: Column, bleeding: Column, labile: Column, elderly: Column, drugs: Column, alcohol: Column) -> Column:
    return _points(*[(c, 1) for c in (htn, renal, liver, stroke, bleeding, labile, elderly, drugs, alcohol)])


def wells_pe(dvt_signs: Column, likely: Column, tachycardia: Column, immobile: Column, previous: Column, hemoptysis: Column, cancer: Column) -> Column:
    half = lambda c, p: F.when(c, p).otherwise(0.0)
    return half(dvt_signs, 3.0) + half(likely, 3.0) + half(tachycardia, 1.5) + half(immobile, 1.5) + half(previous, 1.5) + half(hemoptysis, 1.0) + half(cancer, 1.0)


def wells_dvt(*signs: Column, alternative: Column) -> Column:
    """A point for each sign, two less if another diagnosis is as likely."""
    return _points(*[(c, 1) for c in signs], (alternative, -2))


def qsofa(respiratory_rate: Column, systolic: Column, altered: Column) -> Column:
    return _points((respiratory_rate >= 22, 1), (systolic <= 100, 1), (altered, 1))


def option_points(option: Column) -> Column:
    """The number that a chosen option begins with; null without one."""
    return F.nullif(F.regexp_extract(option, "^ *([0-9]+)", 1), F.lit("")).cast("int")


def option_sum(*options: Column) -> Column:
    """Coma and organ failure scores: the sum of the options' numbers."""
    total = F.lit(0)
    for o in options:
        total = total + F.coalesce(option_points(o), F.lit(0))
    return total


#: Factor and offset of unit conversions.
UNITS = {
    ("glucose", "mmol/L", "mg/dL"): 18.0, ("creatinine", "umol/L", "mg/dL"): 1 / 88.4, ("weight", "lb", "kg"): 0.453592,
    ("height", "in", "cm"): 2.54, ("bilirubin", "umol/L", "mg/dL"): 1 / 17.1,
}


def convert(value: Column, what: str, unit: str, to: str) -> Column:
    if unit == to:
        return value
    if (what, unit, to) in UNITS:
        return value * UNITS[what, unit, to]
    return value / UNITS[what, to, unit]


#: Doses of equal effect in mg, and oral morphine per mg.
STEROIDS = {"hydrocortisone": 20.0, "prednisone": 5.0, "methylprednisolone": 4.0, "dexamethasone": 0.75}
OPIOIDS = {"morphine": 1.0, "oxycodone": 1.5, "hydromorphone": 4.0, "codeine": 0.15, "tramadol": 0.1}


def steroid_equivalent(dose: Column, source: str, target: str) -> Column:
    return js_round(dose / STEROIDS[source] * STEROIDS[target], 2)


def morphine_equivalent(dose: Column, drug: str) -> Column:
    return js_round(dose * OPIOIDS[drug], 1)


def check_bounds(value: Column, hard: tuple[float, float], soft: tuple[float, float]) -> Column:
    return F.when(value.isNull(), "missing").when((value < hard[0]) | (value > hard[1]), "impossible").when((value < soft[0]) | (value > soft[1]), "unusual").otherwise("ok")


def lab_status(value: Column, low: float, high: float, crit_low: float, crit_high: float, plausible: tuple[float, float], inclusive: bool = False) -> Column:
    """Vital signs are critical at the upper limit already (``inclusive``), laboratory values beyond it."""
    above = value >= crit_high if inclusive else value > crit_high
    return (
        F.when((value < plausible[0]) | (value > plausible[1]), "implausible")
        .when(value < crit_low, "critical_low").when(above, "critical_high").when(value < low, "low").when(value > high, "high").otherwise("normal")
    )
