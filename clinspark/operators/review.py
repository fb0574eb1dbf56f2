"""Record review: cross-field checks, suggestions apart from facts, review levels, and the choice between readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.functions.scalar import clamp
from clinspark.operators.text_rules import Rule, whole_words
from clinspark.sources.store import dealt

#: Own small rule sets: what a text suggests, the most serious outcome first. No match is "not assessed", not "none".
MOBILITY_RULES = (
    Rule("M1", "ventilator|intubated|ecmo", "CRITICAL_TRANSPORT", 3, 0.95), Rule("M2", "hip fracture|paralysed|bedbound", "STRETCHER", 2, 0.85),
    Rule("M3", "weakness|amputation|wheelchair", "WHEELCHAIR", 1, 0.7), Rule("M4", "walking|ambulatory", "AMBULATORY", 0, 0.8),
)
OXYGEN_RULES = (Rule("O1", "ventilator|intubated", "VENTILATOR", 4, 0.95), Rule("O2", "bipap|cpap|niv", "BIPAP", 3, 0.9), Rule("O3", "nrb|hfnc|high flow", "NON_REBREATHER", 2, 0.85), Rule("O4", "face mask", "FACE_MASK", 1, 0.8), Rule("O5", "nasal cannula|nc", "NASAL_CANNULA", 0, 0.75))
ISOLATION_RULES = (Rule("I1", "tb|tuberculosis|measles|covid", "AIRBORNE", 3, 0.9), Rule("I2", "influenza|meningitis", "DROPLET", 2, 0.85), Rule("I3", "mrsa|vre|c diff", "CONTACT", 1, 0.85))
#: Words that raise acuity, and their weights.
ACUITY = (("cardiac arrest|ventilator|septic shock", 1.0), ("stemi|stroke|dka", 0.85), ("sepsis|nstemi|gi bleed", 0.6), ("pneumonia|copd", 0.5), ("uti|cellulitis", 0.25))


def suggest(text: Column, rules: Sequence[Rule]) -> Column:
    """struct<outcome, confidence, rule, status>: a suggestion stays UNVALIDATED; null if no rule speaks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.rlike(whole_words(r.pattern)), F.struct(F.lit(r.severity).alias("s"), F.lit(-i).alias("i"), F.lit(r.outcome).alias("outcome"), F.lit(r.confidence).alias("confidence"), F.lit(r.code).alias("rule"))) for i, r in enumerate(rules)]))
    best = F.array_max(hits)
    return F.when(best.isNotNull(), F.struct(best["outcome"].alias("outcome"), best["confidence"].alias("confidence"), best["rule"].alias("rule"), F.lit("UNVALIDATED").alias("status")))


def acuity(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.greatest(F.lit(0.0), *[F.when(low.rlike(whole_words(p)), w).otherwise(0.0) for p, w in ACUITY])


def acuity_triage(score: Column) -> Column:
    return F.when(score >= 0.8, "RED").when(score >= 0.5, "YELLOW").otherwise("GREEN")


def cross_checks(age: Column, gender: Column, dx: Column, meds: Column) -> Column:
    """array<struct<field, severity, code>> of what doesn't go together; whole words only, one entry for each rule."""
    d, m = F.lower(F.coalesce(dx, F.lit(""))), F.lower(F.coalesce(meds, F.lit("")))
    rules = [
        ("age", "ERROR", "AGE_IMPLAUSIBLE", (age < 0) | (age > 120)),
        ("dx", "WARN", "UNUSUAL_FOR_AGE", (age < 18) & d.rlike(whole_words("nstemi|stemi|mi|cad|copd"))),
        ("gender", "ERROR", "DX_NOT_FOR_MALE", (gender == "M") & d.rlike(whole_words("ovarian|ectopic pregnancy"))),
        ("gender", "ERROR", "DX_NOT_FOR_FEMALE", (gender == "F") & d.rlike(whole_words("prostate|testicular"))),
        ("meds", "CLINICAL_ALERT", "METFORMIN_KIDNEY", m.rlike(whole_words("metformin")) & d.rlike(whole_words("ckd5|esrd"))),
        ("dx", "WARN", "INSULIN_WITHOUT_DIABETES", m.rlike(whole_words("insulin|glargine")) & ~d.rlike("dm|diabet|dka")),
        ("dx", "WARN", "ANTICOAGULANT_WITHOUT_CAUSE", m.rlike(whole_words("heparin|enoxaparin")) & ~d.rlike(whole_words("dvt|pe|acs|nstemi|stemi|af"))),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(s).alias("severity"), F.lit(k).alias("code"))) for f, s, k, c in rules]))


def distinct_flags(flags: Column) -> Column:
    return F.array_distinct(flags)


def review_level(identifiers: Column, confidence: Column, reasons: Column, warnings: Column) -> Column:
    """VERIFY for severe warnings, low confidence or no identifier; REVIEW for any reason; else READY."""
    severe = F.exists(warnings, lambda w: w["severity"].isin("ERROR", "CLINICAL_ALERT"))
    return F.when(severe | (confidence < 0.52) | (identifiers == 0), "VERIFY").when((F.size(reasons) > 0) | (F.size(warnings) > 0) | (confidence < 0.8), "REVIEW").otherwise("READY")


def readiness(rules: Sequence[tuple[str, Column]]) -> dict[str, Column]:
    """blockers and ready: nothing may stand against an import."""
    blockers = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(code)) for code, c in rules]))
    return {"blockers": blockers, "ready": F.size(blockers) == 0}


def hypothesis_score(confidence: Column, ready: Column, coverage: Column, completeness: Column, structure: Column) -> Column:
    return clamp(confidence * 0.46 + ready * 0.18 + coverage * 0.18 + completeness * 0.12 + structure * 0.06, 0.0, 1.0)


def best_hypothesis(table: DataFrame, doc: str, kind: str, score: str, n: str, structured: Sequence[str]) -> DataFrame:
    """One reading for each document: the best, or a structured one within 0.03 of it that loses at most one record."""
    w = Window.partitionBy(doc).orderBy(F.desc(score), F.desc(n), kind)
    ranked = dealt(table, doc).withColumns({"__r": F.row_number().over(w).cast("long"), "__best": F.first(score).over(w), "__n": F.first(n).over(w)})
    near = F.col(kind).isin(list(structured)) & (F.col("__best") - F.col(score) <= 0.03) & (F.col(n) >= F.greatest(F.lit(1), F.col("__n") - 1))
    place = F.when(near, 0).otherwise(1 << 40) + F.col("__r")  # the rows are in this order's groups already, so they aren't sorted again
    pick = ranked.withColumn("__place", place).withColumn("__p", F.min("__place").over(Window.partitionBy(doc)))
    return pick.where("__p = __place").drop("__r", "__best", "__n", "__place", "__p")


def fuse_passes(table: DataFrame, doc: str, score: str) -> DataFrame:
    """Passes within 0.12 of the best and of 0.64 at least; the best gains 0.02 for each further one."""
    best = F.max(score).over(Window.partitionBy(doc))
    kept = table.withColumn("__b", best).where((F.col("__b") - F.col(score) <= 0.12) & ((F.col(score) >= 0.64) | (F.col(score) == F.col("__b"))))
    return kept.groupBy(doc).agg(F.count("*").alias("passes"), F.least(F.max(score) + 0.02 * (F.count("*") - 1), F.lit(1.0)).alias("score"))


def consolidated(table: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """The worst review level of each group."""
    rank = F.when(F.col(level) == "VERIFY", 2).when(F.col(level) == "REVIEW", 1).otherwise(0)
    return table.groupBy(*keys).agg(F.element_at(F.array(F.lit("READY"), F.lit("REVIEW"), F.lit("VERIFY")), F.max(rank) + 1).alias(level))


def predicted_gender(name: Column, female: Sequence[str], male: Sequence[str]) -> Column:
    first = F.upper(F.substring_index(F.trim(name), " ", 1))
    return F.when(first.isin([n.upper() for n in female]), "F").when(first.isin([n.upper() for n in male]), "M")


def verdict(metrics: dict[str, Column], thresholds: dict[str, tuple[str, float]], synthetic: Column) -> dict[str, Column]:
    """failed metrics, and whether all hold; synthetic data never passes, a missing metric fails."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(metrics[k] <= t if way == "max" else metrics[k] >= t, F.lit(False)), F.lit(k)) for k, (way, t) in thresholds.items()]))
    return {"failed": bad, "medical_grade": (F.size(bad) == 0) & ~F.coalesce(synthetic, F.lit(True))}
