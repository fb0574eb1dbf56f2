"""Rule tables over text: first-match outcomes, extraction to structs, redaction, entity scores and synthetic noise."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A pattern that suggests an outcome; higher severity wins, then the earlier rule."""

    code: str
    pattern: str
    outcome: str
    severity: int
    confidence: float


#: Own small rule set; patterns are lower-case and match between characters that are no letters or digits.
TRIAGE_RULES = (
    Rule("R01", "cardiac arrest|ventilator|intubated", "RED", 3, 0.97),
    Rule("R02", "stemi", "RED", 3, 0.95),
    Rule("R03", "septic shock|sepsis", "RED", 3, 0.9),
    Rule("R04", "nstemi", "YELLOW", 2, 0.85),
    Rule("R05", "pneumonia|copd", "YELLOW", 2, 0.8),
    Rule("R06", "pe", "YELLOW", 2, 0.7),
    Rule("R07", "uti|cellulitis", "GREEN", 1, 0.75),
    Rule("R08", "observation|stable", "GREEN", 1, 0.6),
)


def whole_words(pattern: str) -> str:
    return f"(?:^|[^a-z0-9])(?:{pattern})(?:[^a-z0-9]|$)"


def apply_rules(text: Column, rules: Sequence[Rule] = TRIAGE_RULES) -> dict[str, Column]:
    """rule, outcome, confidence and conflict; all null where nothing matches: not assessed isn't negative."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.rlike(whole_words(r.pattern)), F.struct(F.lit(r.severity).alias("s"), F.lit(-i).alias("i"), F.lit(r.code).alias("code"), F.lit(r.outcome).alias("outcome"), F.lit(r.confidence).alias("confidence"))) for i, r in enumerate(rules)]))
    best = F.array_max(hits)
    return {"rule": best["code"], "outcome": best["outcome"], "confidence": best["confidence"], "conflict": F.size(F.array_distinct(F.transform(hits, lambda h: h["outcome"]))) > 1}


#: Identifiers that are masked, in this order; the first that covers a place takes it. {<} and {>} are borders of words, and
#: a group is what is masked of a longer match.
IDENTIFIERS = (
    ("EMAIL", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    ("CARD", "{<}[0-9]{16}{>}"),
    ("CIVIL_ID", "{<}[123][0-9]{11}{>}"),
    ("MRN", "(?i)({<}(?:MRN|File|ID)[:\\s#]*)[0-9]{6,8}{>}"),
    ("DOB", "(?i){<}(?:DOB|D[.]O[.]B|Date of Birth)[:\\s]*[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}{>}"),
    ("PHONE", "(?:[+]965[ -]?)?{<}[0-9]{4}[ -]?[0-9]{4}{>}"),
)


def native_pattern(pattern: str) -> str:
    """Borders of words of letters A to Z, digits and underscores, as Spark's patterns express them."""
    return pattern.replace("{<}", "(?<![0-9A-Za-z_])").replace("{>}", "(?![0-9A-Za-z_])")


def plain_pattern(pattern: str) -> str:
    """The same for engines whose borders of words know those characters alone."""
    return pattern.replace("{<}", "\\b").replace("{>}", "\\b")


def mask(text: Column, identifiers: Sequence[tuple[str, str]] = IDENTIFIERS) -> Column:
    for name, pattern in identifiers:
        text = F.regexp_replace(text, native_pattern(pattern), ("$1" if name == "MRN" else "") + f"[{name}]")
    return text


#: What every match of an identifier holds: texts without it needn't be searched.
NEEDS = {"EMAIL": "@", "CARD": "[0-9]{16}", "CIVIL_ID": "[0-9]{12}", "MRN": "[0-9]{6}", "DOB": "[0-9][/.-][0-9]", "PHONE": "[0-9]{4}"}


def mask_steps(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __mask0, their text, to __mask6, each with one identifier more masked; a step is worked out once, and only where it can match."""
    out = docs.withColumn("__mask0", F.col(text))
    for k, one in enumerate(IDENTIFIERS):
        before = F.col(f"__mask{k}")
        out = out.withColumn(f"__mask{k + 1}", F.when(before.rlike(NEEDS[one[0]]), mask(before, [one])).otherwise(before))
    return out


def vault(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, token (numbered over all kinds of a document, in order of kind and place) and hash of every identifier that is masked."""

    def of(k: int) -> Column:
        name, pattern = IDENTIFIERS[k]
        seen = F.regexp_extract_all(F.col(f"__mask{k}"), F.lit(native_pattern(pattern)), F.lit(0))
        listed = F.transform(seen, lambda v: F.struct(F.lit(name).alias("kind"), (F.regexp_extract(v, "[0-9]+$", 0) if name == "MRN" else v).alias("value")))
        return F.when(F.col(f"__mask{k}") != F.col(f"__mask{k + 1}"), listed).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))

    steps = mask_steps(docs.where(F.col(text).isNotNull()).select(F.col(key), F.col(text)), text)
    at = steps.select(F.col(key), F.concat(*[of(k) for k in range(len(IDENTIFIERS))]).alias("found")).where(F.size("found") > 0).select(key, F.posexplode("found").alias("i", "v"))
    return at.select(key, F.concat(F.lit("["), F.col("v.kind"), F.lit("_"), F.lpad(F.col("i").cast("string"), 4, "0"), F.lit("]")).alias("token"), F.sha2("v.value", 256).alias("hash"))


#: Vital signs and laboratory values in running text: name, pattern with one group.
MEASURES = (
    ("hr", "(?:hr|pulse)[ :=]*([0-9]{2,3})"), ("spo2", "(?:spo2|sat)[ :=]*([0-9]{2,3})"), ("temp", "(?:temp|t)[ :=]+([0-9]{2}[.][0-9])"),
    ("rr", "(?:rr)[ :=]*([0-9]{1,2})"), ("hb", "(?:hb|hgb)[ :=]*([0-9]{1,2}(?:[.][0-9])?)"), ("wbc", "(?:wbc)[ :=]*([0-9]{1,3}(?:[.][0-9])?)"),
    ("plt", "(?:plt|platelets)[ :=]*([0-9]{1,4})"), ("k", "(?:^|[^a-z])k[ :=]+([0-9](?:[.][0-9])?)"),
)


def measures(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {name: F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("double") for name, p in MEASURES}


def entity_scores(token: Column, upper: Column | None = None) -> Column:
    """array of struct<confidence, order, entity>: every scorer's verdict on one token; the maximum wins, ties to the earlier.

    upper: the trimmed token in upper case, if there is a column of it. What holds a digit or a sign in any case is only
    looked for in tokens with one.
    """
    t, u = F.trim(token), F.upper(F.trim(token)) if upper is None else upper
    age = F.nullif(F.regexp_extract(u, "^([0-9]{1,3})[ /-]*[MF]$", 1), F.lit("")).cast("int")
    scorers = [
        ("BED", F.when(u.rlike("^[A-Z]{1,3}-[MF]-?[0-9]{1,3}$"), 0.99).when(u.rlike("^(BED|RM|ROOM)[ -]?[0-9]{1,3}[A-Z]?$"), 0.95).when(u.rlike("^[A-Z]{1,2}[0-9]{1,3}$"), 0.72)),
        ("AGE_GENDER", F.when(age.between(1, 129), 0.95)),
        ("AGE", F.when(u.rlike("^[0-9]{1,3} ?(Y|YRS|YEARS)$"), 0.9).when(u.rlike("^[0-9]{1,2}$"), 0.5)),
        ("GENDER", F.when(u.isin("MALE", "FEMALE"), 0.95).when(u.isin("M", "F"), 0.6)),
        ("CIVIL_ID", F.when(u.rlike("^[23][0-9]{11}$"), 0.97).when(u.rlike("^MRN[ :-]?[0-9]{4,}$"), 0.85)),
        ("WARD", F.when(u.rlike("^(WARD|ICU|CCU|NICU|ER)( ?[0-9A-Z]{0,3})$"), 0.9)),
        ("O2", F.when(u.isin("VENTILATOR", "BIPAP", "CPAP", "HFNC", "NRB"), 0.95).when(u.isin("NC", "FM"), 0.85)),
        ("ISOLATION", F.when(u.isin("AIRBORNE", "DROPLET", "CONTACT", "NEUTROPENIC"), 0.9)),
        ("MOBILITY", F.when(u.isin("AMBULATORY", "WHEELCHAIR", "STRETCHER", "BEDRIDDEN"), 0.9)),
        ("BLOOD_TYPE", F.when(u.rlike("^(A|B|AB|O)[+-]$"), 0.92)),
        ("ASSIGNED_DOCTOR", F.when(u.rlike("^DR[. ]+[A-Z]+"), 0.88)),
        ("STATUS", F.when(u.isin("DNR", "DNI", "FULL CODE"), 1.0).when(u.isin("COMFORT", "NFR"), 0.9)),
        ("TRIAGE", F.when(u.isin("RED", "YELLOW", "GREEN"), 0.98)),
        ("ALLERGY", F.when(u.isin("NKDA", "NKA"), 1.0).when(u.rlike("^ALLERG"), 0.8)),
        ("DIAGNOSIS", F.when(u.isin("STEMI", "NSTEMI", "DM2", "HTN", "COPD", "UTI", "CKD", "CHF", "PE", "DVT", "SEPSIS"), 0.92)),
        ("MEDICATION", F.when(u.rlike("(CILLIN|MYCIN|OLOL|PRIL|SARTAN|STATIN|AZOLE)$"), 0.9)),
        ("NAME", F.when(t.rlike("^[A-Z][a-z]{2,}$"), 0.7)),
    ]
    verdicts = [(e, F.when(s.isNotNull(), F.struct(s.cast("double").alias("confidence"), F.lit(-i).alias("order"), F.lit(e).alias("entity")))) for i, (e, s) in enumerate(scorers)]
    return F.array_compact(F.when(u.rlike("[0-9+-]"), F.array(*[v for _, v in verdicts])).otherwise(F.array(*[v for e, v in verdicts if e not in SIGNED])))


#: Entities whose patterns all hold a digit or a sign.
SIGNED = frozenset({"BED", "AGE_GENDER", "AGE", "CIVIL_ID", "BLOOD_TYPE"})


def classify_token(token: Column, cutoff: float = 0.3, upper: Column | None = None) -> Column:
    best = F.array_max(entity_scores(token, upper))
    return F.when(best["confidence"] * 0.8 + 0.2 > cutoff, best["entity"]).otherwise("UNKNOWN")


def plain_text_words(docs: DataFrame, key: str, text: str, char_w: float = 10.0, line_h: float = 30.0) -> DataFrame:
    """Words of plain text with boxes, as if each character and line had a fixed size; lines of up to two characters go."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw")).where(F.length(F.trim("raw")) > 2)
    words = lines.select(key, "line", F.split(F.trim(F.regexp_replace("raw", "[ \\t]+", " ")), " ").alias("ws"))
    at = words.select(key, "line", F.posexplode("ws").alias("i", "text"))
    # A word begins after the words before it in its line and a space for each.
    w = Window.partitionBy(key, "line").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("before", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    x = F.col("before") * char_w
    return at.select(key, "line", "i", "text", x.alias("x"), (F.col("line") * line_h).alias("y"), (F.length("text") * char_w).alias("w"), F.lit(20.0).alias("h"), (x + F.length("text") * char_w / 2).alias("cx"), (F.col("line") * line_h + 10.0).alias("cy"))


def noisy(text: Column, key: Column, rate: float, swaps: dict[str, str]) -> Column:
    """Characters replaced by look-alikes where a hash of key and place says so: the same noise every time."""
    chars = F.split(text, "")
    out = F.transform(chars, lambda c, i: F.when(F.pmod(F.xxhash64(key, i), F.lit(10_000)) < int(rate * 10_000), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in swaps.items() for x in kv]), c), c)).otherwise(c))
    return F.array_join(out, "")


def hash_split(value: Column, train: float = 0.9, validation: float = 0.97) -> Column:
    """By the first byte of the SHA-1, so a value always lands in the same part."""
    b = F.conv(F.substring(F.sha1(value), 1, 2), 16, 10).cast("int") / 255
    return F.when(b < train, "train").when(b < validation, "validation").otherwise("test")
