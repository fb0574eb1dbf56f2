"""Column functions for text keys, numbers, dates and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and letter variants that Arabic search keys ignore.
ARABIC_MARKS = "[ً-ٰٟ]"
ARABIC_FROM, ARABIC_TO = "أإآةى", "اااهي"
#: Characters that recognisers mix up, and the one that stands for each group.
CONFUSABLE_FROM = "OQDIL|!ZSGTB"
CONFUSABLE_TO = "000111125678"


#: Letters whose capitals are several letters by the full rules; those that have one of their own by the simple rules.
_SEVERAL = "".join(c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1)
_CAPITAL = {"ß": "ẞ"} | {c: c.title() for c in _SEVERAL if len(c.title()) == 1}


def simple_upper(c: Column) -> Column:
    """Upper case letter for letter, so that no letter becomes several: ß is ẞ, not SS, and ligatures stay."""
    one = F.translate(c, "".join(_CAPITAL), "".join(_CAPITAL.values()))
    kept = "[" + _SEVERAL + "]"
    return F.when(one.rlike(kept), F.array_join(F.transform(F.split(one, ""), lambda x: F.when(x.rlike(kept), x).otherwise(F.upper(x))), "")).otherwise(F.upper(one))


def missing_to_null(c: Column) -> Column:
    """Null, empty and blank all mean missing."""
    return F.nullif(F.trim(c), F.lit(""))


def js_round(c: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = 10**digits
    r = F.floor(c * scale + 0.5)
    return r.cast("long") if digits == 0 else r.cast("double") / scale


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def normalize_arabic(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO)


def canonical_token(c: Column) -> Column:
    """Upper case, each group of confusable characters as one of them."""
    return F.translate(F.upper(c), CONFUSABLE_FROM, CONFUSABLE_TO)


def bed_key(c: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(c, "[ \\t]+", "")), "OQ|IL", "00111")


def bed_text(c: Column) -> Column:
    """A bed's name as sheets write it: ``Room 12``, ``Bed 3``, ``ICU-4``, ``A-M-07``, ``401-1``; anything else with its prefix spelled out."""
    raw = F.trim(c)
    compact = F.regexp_replace(raw, "\\s+", "")
    up = F.upper(compact)
    prefix = F.translate(F.regexp_extract(up, "^([A-Z0-9-]+?)([0-9]{1,3})$", 1), "01", "OI")
    digits = F.regexp_extract(up, "^([A-Z0-9-]+?)([0-9]{1,3})$", 2)
    canonical = F.regexp_replace(F.replace(F.upper(raw), F.lit("O"), F.lit("0")), "\\s+", "")
    unit = "^(ICU|CCU|HDU|NICU|PICU)-?([0-9]{1,2})$"
    spelled = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "(?i)^r[0o]{2}m\\s*", "Room "), "(?i)^rm\\s*", "Room "), "(?i)^bed\\s*", "Bed ")
    return (
        F.when(raw == "", raw)
        .when(prefix.isin("ROOM", "RM"), F.concat(F.lit("Room "), digits))
        .when(prefix.isin("BED", "B"), F.concat(F.lit("Bed "), digits))
        .when(prefix.rlike("^(?:ICU|CCU|HDU|NICU|PICU)$"), F.concat(prefix, F.lit("-"), digits))
        .when(canonical.rlike("^(?:[A-E]-[MF]-[0-9]{1,2}|[0-9]{1,3}-[0-9]{1,3}|[0-9][A-Z]-[0-9]{1,2})$"), canonical)
        .when(up.rlike(unit), F.regexp_replace(up, unit, "$1-$2"))
        .otherwise(F.trim(F.regexp_replace(spelled, "\\s+", " ")))
    )


def sheet_label(c: Column) -> Column:
    """A header's label with blanks for underscores, colons and brackets, one slash between parts and ``no`` for number."""
    steps = [("[_:]+", " "), ("[|]+", "/"), ("[()]+", " "), ("(?i)\\bnumber\\b", "no"), ("\\s*[/\\\\]\\s*", "/"), ("\\s+", " "), ("[:\\\\-]+$", "")]
    out = F.trim(F.coalesce(c, F.lit("")))
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


#: Header words of a sheet.
_HEADERS = "(?i)^(bed|room|rm|patient|patient name|name|age|sex|age/sex|gender|dx|diagnosis|diagnoses|problems?|meds|medications?|treatment|dr|doctor|consultant|physician|status|code|triage|ward|civil id|mrn|file no|no|notes?|plan)( ?(no|#))?[.:]?$"


def header_label(c: Column) -> Column:
    """The label of a header cell, or null for any other text; ``Dr`` alone is a title."""
    label = sheet_label(c)
    return F.when(label.rlike(_HEADERS) & ~label.rlike("(?i)^dr[.]?$"), label)


#: Rewrites of free text to one form, in this order, each over the result of those before.
REWRITES = (
    (r"(?i)\bH/?T(?:N)?\b", "HTN"), (r"(?i)\bD\.?M\.?\s*(?:type\s*)?2?\b", "DM2"), (r"(?i)\bD\.?M\.?\s*(?:type\s*)?1\b", "DM1"), (r"(?i)\bC\.?K\.?D\.?\s*(\d)\b", "CKD$1"),
    (r"(?i)\bA\.?\s*fib\b", "AF"), (r"(?i)\bA\.?\s*flutter\b", "Atrial flutter"), (r"(?i)\bC\.?O\.?P\.?D\.?\b", "COPD"), (r"(?i)\bC\.?H\.?F\.?\b", "CHF"),
    (r"(?i)\bU\.?T\.?I\.?\b", "UTI"), (r"(?i)\bD\.?V\.?T\.?\b", "DVT"), (r"\bP\.?E\.?\b", "PE"), (r"(?i)\bC\.?V\.?A\.?\b", "CVA"), (r"(?i)\bA\.?K\.?I\.?\b", "AKI"),
    (r"(?i)\bS\.?O\.?B\.?\b", "SOB"), (r"(?i)\bN/V\b", "Nausea/Vomiting"), (r"(?i)\bAb(?:d|do)(?:ominal)?\s*pain\b", "Abdominal pain"), (r"(?i)\bN\.?K\.?D\.?A\.?\b", "NKDA"),
    (r"\s*[,;]\s*", ", "), (r"\s+", " "),
)


def standard_text(c: Column) -> Column:
    """Free text with abbreviations and separators in one form; null counts as empty."""
    out = F.trim(F.coalesce(c, F.lit("")))
    for pattern, new in REWRITES:
        out = F.regexp_replace(out, pattern, new)
    return out


def civil_id_key(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "[ \\t-]+", ""), "OoIl|", "00111")


def name_key(c: Column) -> Column:
    """Letters alone, upper case, single spaces."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z ]", ""), " +", " ")))


def metric_key(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\r\\n]+", " "))


def phrase_tokens(c: Column) -> Column:
    """Split at white space and list marks, punctuation trimmed, blanks dropped."""
    parts = F.split(c, "[ \\t\\r\\n,;/|]+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[.:()\\[\\]\"']+|[.:()\\[\\]\"']+$", "")), lambda x: x != "")


def list_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")


def merge_lists(a: Column, b: Column) -> Column:
    """Union in order of first appearance."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def text_density(c: Column) -> Column:
    """Letters and digits over characters that aren't white space; null for blank texts."""
    seen = F.length(F.regexp_replace(c, "[ \\t\\r\\n]", ""))
    return F.when(seen > 0, F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) / seen)


def script_of(c: Column) -> Column:
    arabic, latin = c.rlike("[؀-ۿ]"), c.rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(latin, "latin").otherwise("none")


def preserve_case(model: Column, word: Column) -> Column:
    """The word in the case of its model: upper, title or lower."""
    first = F.substring(model, 1, 1)
    return (
        F.when((F.length(model) > 1) & (model == F.upper(model)) & (model != F.lower(model)), F.upper(word))
        .when((first == F.upper(first)) & (first != F.lower(first)), F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000))))
        .otherwise(F.lower(word))
    )


#: Pairs of letters that are read as one, applied in this order.
DIGRAPHS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("nn", "m"), ("ii", "u"), ("li", "h"), ("ri", "n"))


def fix_digraphs(c: Column) -> Column:
    for a, b in DIGRAPHS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cer(predicted: Column, reference: Column) -> Column:
    """Edits over the reference's length; against an empty reference 1 if anything was predicted, else 0."""
    p, r = F.coalesce(predicted, F.lit("")), F.coalesce(reference, F.lit(""))
    return F.when(F.length(r) == 0, F.when(F.length(p) > 0, 1.0).otherwise(0.0)).otherwise(F.levenshtein(p, r) / F.length(r))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "HIGH").when(c >= 0.7, "MEDIUM").otherwise("LOW")


def confidence_route(c: Column) -> Column:
    return F.when(c >= 0.92, "accepted").when(c >= 0.5, "review").otherwise("rejected")


def upper_quantile(sorted_values: Column, p: float) -> Column:
    """The element at floor(n * p) of an ascending array, the last one at most: no interpolation."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(F.floor(n * F.lit(p)), n - 1).cast("int"))


# --- machine-readable travel documents and civil ids -------------------------------------------------------------------


def mrz_check_digit(c: Column) -> Column:
    """Weights 7, 3, 1 over digits, letters (A = 10) and fillers (0), modulo 10."""
    chars = F.split(F.upper(c), "")
    value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).when(x.between("A", "Z"), F.ascii(x) - 55).otherwise(0)
    weighted = F.transform(chars, lambda x, i: value(x) * F.when(i % 3 == 0, 7).when(i % 3 == 1, 3).otherwise(1))
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 10


def key_seed(number: Column, birth: Column, expiry: Column) -> Column:
    """What a chip's access key is derived from: document number (filled up to nine), birth and expiry, each with its check digit."""
    filled = F.rpad(F.upper(number), F.greatest(F.length(number), F.lit(9)), F.lit("<"))
    return F.concat(*[F.concat(x, mrz_check_digit(x).cast("string")) for x in (filled, birth, expiry)])


def mrz_date(c: Column, pivot: int) -> Column:
    """YYMMDD; years beyond the pivot belong to the 1900s. Null if there is no such day."""
    yy = F.substring(c, 1, 2).cast("int")
    year = F.when(yy > pivot, 1900 + yy).otherwise(2000 + yy)
    return F.try_to_date(F.concat(year.cast("string"), F.substring(c, 3, 4)), "yyyyMMdd")


def parse_td1(line1: Column, line2: Column, line3: Column) -> dict[str, Column]:
    """Fields of a three-line document of 30 columns each, short lines filled up."""
    a, b, d = (F.rpad(x, 30, "<") for x in (line1, line2, line3))
    clean = lambda x: F.trim(F.replace(x, F.lit("<"), F.lit(" ")))
    names = F.split(d, "<<")
    return {
        "document_code": clean(F.substring(a, 1, 2)), "issuer": clean(F.substring(a, 3, 3)), "document_number": clean(F.substring(a, 6, 9)),
        "number_ok": mrz_check_digit(F.substring(a, 6, 9)).cast("string") == F.substring(a, 15, 1),
        "birth": mrz_date(F.substring(b, 1, 6), 30), "birth_ok": mrz_check_digit(F.substring(b, 1, 6)).cast("string") == F.substring(b, 7, 1),
        "sex": clean(F.substring(b, 8, 1)), "expiry": mrz_date(F.substring(b, 9, 6), 70),
        "expiry_ok": mrz_check_digit(F.substring(b, 9, 6)).cast("string") == F.substring(b, 15, 1),
        "nationality": clean(F.substring(b, 16, 3)), "surname": clean(F.get(names, 0)), "given_names": clean(F.get(names, 1)),
        "composite_ok": mrz_check_digit(F.concat(F.substring(a, 6, 25), F.substring(b, 1, 7), F.substring(b, 9, 7), F.substring(b, 19, 11))).cast("string") == F.substring(b, 30, 1),
    }


def civil_id_birth(c: Column) -> Column:
    """Twelve digits: a century digit (2: 1900, 3: 2000), then YYMMDD; null if it is no real day."""
    century = F.when(F.substring(c, 1, 1) == "2", "19").when(F.substring(c, 1, 1) == "3", "20")
    return F.when(c.rlike("^[23][0-9]{11}$"), F.try_to_date(F.concat(century, F.substring(c, 2, 6)), "yyyyMMdd"))


def age_at(birth: Column, as_of: Column) -> Column:
    return F.floor(F.datediff(as_of, birth) / 365.25).cast("int")


# --- geometry ----------------------------------------------------------------------------------------------------------


def box_iou(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def decimal_alternatives(digits: Column, low: float, high: float) -> Column:
    """Where a decimal point may have been lost: all splits of a digit string that fall into the range."""
    splits = F.transform(F.sequence(F.lit(1), F.length(digits) - 1), lambda i: F.concat(F.substring(digits, F.lit(1), i), F.lit("."), F.substring(digits, i + 1, F.length(digits))).cast("double"))
    return F.when(F.length(digits) >= 2, F.filter(splits, lambda x: (x >= low) & (x <= high))).otherwise(F.array().cast("array<double>"))
