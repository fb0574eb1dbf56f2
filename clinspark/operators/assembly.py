"""Assembly of records: the classified words of a cluster become one record with a confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clinspark.functions.scalar import clamp
from clinspark.operators.tables import name_score
from clinspark.sources.store import stored

#: What ends the part of a row in which names stand; weights of fields; bonuses for roles of columns.
CLINICAL = ("DIAGNOSIS", "MEDICATION", "TRIAGE", "ASSIGNED_DOCTOR", "SHEET_STATUS", "STATUS", "O2", "ISOLATION")
WEIGHTS = {"name": 3.0, "bed": 2.5, "age_gender": 2.1, "triage": 0.9, "dx": 1.7, "meds": 1.1, "allergies": 0.7, "code": 0.6, "doctor": 0.35, "sheet_status": 0.3}
STRUCTURED = 1.3
SUPPORT = ("ASSIGNED_DOCTOR", "SHEET_STATUS", "WARD", "BED", "GENDER", "AGE_GENDER", "TRIAGE")
ROLE_BONUS = {"doctor": ("ASSIGNED_DOCTOR", 0.05), "sheet_status": ("SHEET_STATUS", 0.04), "triage": ("TRIAGE", 0.04), "ward": ("WARD", 0.04)}
PICKED = {"bed": "BED", "triage": "TRIAGE", "allergies": "ALLERGY", "code": "STATUS", "civil_id": "CIVIL_ID", "ward": "WARD", "o2": "O2", "isolation": "ISOLATION", "mobility": "MOBILITY", "blood_type": "BLOOD_TYPE"}
ARABIC = "[؀-ۿ]"


def resolve(words: DataFrame, known: Column, clinical: Column, doc: str = "doc_id", cluster: str = "row_id", order: str = "i") -> DataFrame:
    """``words`` with what they are taken for (kind) and how surely (sure), each unknown by what its cluster lacks.

    The first bare number left of the clinical part is the bed, if there is none and anything else was read; what looks
    like a name is one on the left and a doctor far on the right; the rest goes to the nearest name or diagnosis. The name
    right of a doctor's title is that doctor's. A cluster is one record: a bounded group, whose unknown words meet its
    names and diagnoses in a join. The words are stored with their scores first: they are read three times, and what they
    were taken for is asked at every turn.
    """
    keys, columns = [doc, cluster], words.columns
    words = stored(words.withColumn("__score", F.when(F.col("entity") == "UNKNOWN", name_score(F.col("text"), known, clinical))))
    asks = words.where(F.col("entity").isin("UNKNOWN", "DOCTOR_TITLE")).select(*keys, order, F.col("entity").alias("__e"), F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("h").alias("__h"))
    there = words.where(F.col("entity").isin("NAME", "DIAGNOSIS")).select(*keys, F.col(order).alias("__o"), F.col("entity").alias("__k"), F.col("cx").alias("__x"), F.col("cy").alias("__y"))
    far = F.sqrt(F.pow((F.col("__cx") - F.col("__x")) * 0.3, 2) + F.pow(F.col("__cy") - F.col("__y"), 2))
    named = (F.col("__e") == "DOCTOR_TITLE") & (F.col("__k") == "NAME") & (F.col("__x") > F.col("__cx")) & (F.abs(F.col("__y") - F.col("__cy")) < F.col("__h") * 1.5)
    near = asks.join(there, keys).groupBy(*keys, order).agg(F.min(F.when(F.col("__k") == "NAME", far)).alias("__to_name"), F.min(F.when(F.col("__k") == "DIAGNOSIS", far)).alias("__to_dx"), F.min(F.when(named, F.struct("__x", "__o")))["__o"].alias("__whose"))
    doctors = near.where("__whose IS NOT NULL").select(*keys, F.col("__whose").alias(order), F.lit(True).alias("__titled")).distinct()
    w = _whole(*keys, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    some = lambda c, over=w: F.coalesce(F.max(F.coalesce(c, F.lit(False))).over(over), F.lit(False))
    unknown, left, text = F.col("entity") == "UNKNOWN", F.min("x").over(w), F.trim("text")
    span = F.greatest(F.lit(1.0), F.max(F.col("x") + F.col("w")).over(w) - left)
    out = words.join(near.drop("__whose"), [*keys, order], "left").join(doctors, [*keys, order], "left")
    out = out.withColumns({
        "__edge": F.coalesce(F.min(F.when(F.col("entity").isin(*CLINICAL), F.col("x"))).over(w) - 10, left + span * 0.48),
        "__right": left + span * 0.62,
        "__names": some((F.col("entity") == "NAME") & F.col("__titled").isNull()),
        "__any": some(F.col("entity").isin("NAME", "DIAGNOSIS", "ASSIGNED_DOCTOR", "SHEET_STATUS")),
        "__bed": some(F.col("entity") == "BED"),
    })
    out = out.withColumn("__left", unknown & (F.col("__score") >= 0.72) & (F.col("cx") <= F.col("__edge")))
    out = out.withColumn("__so_far", some(F.col("__left"), before))
    out = out.withColumn("__number", unknown & text.rlike(r"^\d{1,3}(?:\s*-\s*\d{1,3})?$") & (F.col("cx") <= F.col("__edge")) & (F.col("__any") | F.col("__so_far")))
    is_bed = F.col("__number") & ~F.col("__bed") & ~some(F.col("__number"), before)
    doctor = unknown & (F.col("__score") >= 0.76) & (F.col("__names") | F.col("__so_far")) & (F.col("cx") >= F.col("__right"))
    nearer = F.col("__to_name").isNotNull() & (F.col("__to_dx").isNull() | (F.col("__to_name") < F.col("__to_dx"))) & F.col("text").rlike("[A-Za-z؀-ۿ]")
    detail = F.col("__to_dx").isNotNull() & F.col("text").rlike(r"[A-Z]{2,}|\d")
    kind = F.when(is_bed, "BED").when(F.col("__left"), "NAME").when(doctor, "ASSIGNED_DOCTOR").when(unknown & nearer, "NAME").when(unknown & detail, "DIAGNOSIS").when(F.col("__titled"), "ASSIGNED_DOCTOR").otherwise(F.col("entity"))
    sure = F.when(is_bed, F.lit(0.58)).when(F.col("__left") | doctor, F.greatest("confidence", "__score")).otherwise(F.col("confidence"))
    return out.select(*columns, kind.alias("kind"), sure.alias("sure"))


def _whole(doc: str, cluster: str, order: str) -> WindowSpec:
    """All words of a cluster; in their order, as windows over those before it are, so that one sorting serves both."""
    return Window.partitionBy(doc, cluster).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def assemble(words: DataFrame, known: Column, clinical: Column, doc: str = "doc_id", cluster: str = "row_id", order: str = "i") -> DataFrame:
    """One record for each cluster of ``words`` (entity, text, confidence, x, w, h, cx, cy; role and on_sheet, if known).

    The surest value of a field wins, ties to the first word. A name is read in the direction of its script; lists hold each
    text once. The confidence weighs the fields that were read and how much of a sheet's structure shows. Clusters
    without a name, bed, diagnosis, civil id or age are no records. ``known`` and ``clinical``: lower-case words.
    """
    given = words.withColumns({c: F.lit(v).cast(t) for c, v, t in (("role", None, "string"), ("on_sheet", False, "boolean")) if c not in words.columns})
    r = resolve(given, known, clinical, doc, cluster, order)
    lists = {"names": "NAME", "dx": "DIAGNOSIS", "meds": "MEDICATION", "doctor": "ASSIGNED_DOCTOR", "sheet_status": "SHEET_STATUS"}
    # What all words say of a cluster goes with each of them, so that only words of some kind are grouped: most are of none.
    every = {"base": F.avg("confidence"), "n": F.count("*"), "roles": F.collect_set("role"), "placed": F.count("role"), "on_sheet": F.count(F.when(F.col("on_sheet"), True))}
    w = _whole(doc, cluster, order)
    r = r.select(doc, cluster, order, "entity", "kind", "sure", "text", "cx", *[c.over(w).alias(f"__{f}") for f, c in every.items()]).where(F.col("kind").isin(*PICKED.values(), *lists.values(), "AGE_GENDER", "AGE", "GENDER"))
    at = F.struct((F.col("entity") != F.col("kind")).alias("late"), F.col(order).alias("place"), F.col("cx"), F.trim("text").alias("text"))
    one, first = F.struct("text", "sure"), -F.col(order)
    # First what each kind has to say, then the kinds side by side.
    kinds = r.groupBy(doc, cluster, "kind").agg(
        F.max_by(one, F.struct("sure", first)).alias("best"), F.max_by(one, first).alias("first"), F.max_by(one, order).alias("last"),
        F.array_sort(F.collect_list(at)).alias("all"), F.avg("sure").alias("mean"), *[F.first(f"__{f}").alias(f) for f in every],
    )
    of = lambda k, c: F.first(F.when(F.col("kind") == k, F.col(c)), True)
    age, gender = F.regexp_extract("a.text", r"(\d{1,3})", 1).cast("int"), F.upper(F.regexp_extract("g.text", "([MFmf])", 1))
    n = kinds.groupBy(doc, cluster).agg(
        *[of(k, "best").alias(f) for f, k in PICKED.items()],
        *[F.flatten(F.collect_list(F.when(F.col("kind") == k, F.col("all")))).alias(f) for f, k in lists.items()],
        *[of(k, "mean").alias(f"__{f}") for f, k in lists.items()],
        of("AGE_GENDER", "last").alias("both"), of("AGE", "first").alias("one_age"), of("GENDER", "first").alias("one_gender"),
        *[F.first(f).alias(f) for f in every],
    ).withColumns({"a": F.coalesce("both", "one_age"), "g": F.coalesce("both", "one_gender")})
    texts = lambda c: F.array_distinct(F.filter(F.transform(c, lambda s: s["text"]), lambda t: t != ""))
    across = lambda c, sign=F.lit(1): F.array_sort(F.transform(c, lambda s: F.struct((s["cx"] * sign).alias("cx"), s["late"], s["place"], s["text"])))
    joined = lambda c, by: F.when(F.size(c) > 0, F.array_join(c, by))
    sign = F.when(F.try_element_at("names", F.lit(1))["text"].rlike(ARABIC), -1).otherwise(1)
    fields = n.select(
        doc, cluster, "n", "base", "roles", "placed", "on_sheet", F.size("dx").alias("n_dx"),
        joined(texts(across(F.col("names"), sign)), " ").alias("name"), F.col("__names").alias("name_sure"),
        joined(texts(F.col("dx")), ", ").alias("dx"), F.col("__dx").alias("dx_sure"),
        joined(texts(F.col("meds")), ", ").alias("meds"), F.col("__meds").alias("meds_sure"),
        *[x for f in ("doctor", "sheet_status") for x in (joined(texts(across(F.col(f))), " ").alias(f), F.col(f"__{f}").alias(f"{f}_sure"))],
        *[x for f in PICKED for x in ((F.regexp_replace(f"{f}.text", r"\s+", "") if f == "bed" else F.upper(f"{f}.text") if f == "triage" else F.col(f)["text"]).alias(f), F.col(f)["sure"].alias(f"{f}_sure"))],
        age.alias("age"), F.coalesce("both.sure", "one_age.sure").alias("age_sure"),
        gender.alias("gender"), F.coalesce("both.sure", "one_gender.sure").alias("gender_sure"),
        F.col("both.sure").alias("age_gender_sure"),
    )
    return fields.where("name IS NOT NULL OR bed IS NOT NULL OR n_dx > 0 OR civil_id IS NOT NULL OR age IS NOT NULL").select(
        doc, cluster, "name", "bed", "age", "gender", "triage", "dx", "meds", "doctor", "sheet_status", *[f for f in PICKED if f not in ("bed", "triage")], _confidence().alias("confidence")
    )


def _confidence() -> Column:
    has, col = lambda f: F.col(f).isNotNull(), F.col
    role = lambda k: F.array_contains("roles", k)
    given = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    total = lambda cs: reduce(lambda a, b: a + b, cs)
    core = role("NAME") & role("DIAGNOSIS")
    support = F.least(total([role(k).cast("int") for k in SUPPORT]), F.lit(4))
    triplet = core & (col("placed") >= 3) & (has("doctor") | has("sheet_status"))
    sparse = triplet & col("bed").isNull() & col("age").isNull() & col("gender").isNull() & col("civil_id").isNull()
    structured = clamp(given(core, 0.48) + support * 0.08 + F.least(col("placed"), F.lit(6)) * 0.035 + F.least(col("on_sheet"), F.lit(3)) * 0.05 + given(triplet, 0.07) + given(sparse, 0.04), 0.0, 1.0)
    weights = {f: F.lit(v) for f, v in WEIGHTS.items()} | {"age": F.when(has("gender"), 0.4).otherwise(1.1), "gender": F.when(has("age"), 0.4).otherwise(1.1)}
    parts = [(F.coalesce(F.col(f"{f}_sure") * v, F.lit(0.0)), F.when(has(f"{f}_sure"), v).otherwise(0.0)) for f, v in weights.items()]
    weighed = (total([p for p, _ in parts]) + structured * STRUCTURED) / (total([q for _, q in parts]) + STRUCTURED)
    bonus = given(has("name") & has("dx") & core, 0.12) + total([given(has(f) & role(k), v) for f, (k, v) in ROLE_BONUS.items()]) + F.least(col("on_sheet"), F.lit(2)) * 0.03 + given(col("placed") >= 3, 0.05) + given(triplet, 0.06) + given(sparse, 0.04)
    return clamp(weighed + F.least(col("n"), F.lit(6)) / 6 * 0.08 + bonus, 0.0, 1.0)
