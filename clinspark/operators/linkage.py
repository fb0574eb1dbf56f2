"""Linkage of records that are one person's: an ordered cascade of rules on bed, civil number, name, gender, age and treatment.

Different records are profiles, linked once however often they occur. Nothing is held against everything: profiles meet if
they share a bed or a number (stars, no pairs), if their names are within the edits that a rule allows (a segment join over
different names), or if one's diagnosis or drugs contain the other's at about one age (a containment join over different
texts, by the shorter one's rarest gram). Profiles of two different beds are never paired.

Profiles aren't paired either. Where two have no bed in common and no number in common, the rules ask of these only whether
they are there. So profiles that agree in all that a rule looks at are a class: the rule links all of two classes or none,
and what is linked hangs together by one link between the classes and a star inside each. Ages of two classes that may be so
far apart are linked to the next ones of the other class alone: what lies between two ages that may be linked may be, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.functions.scalar import bed_key, civil_id_key, name_key
from clinspark.operators import fuzzy, weighted
from clinspark.operators.evidence import lexicon_key
from clinspark.operators.records import merge_groups, stars
from clinspark.sources.store import cut_lineage

#: Fixed limits of the rules: ages that part records, that go with a like name, that count as the same; edits of names.
FAR_AGE, LIKE_AGE, SAME_AGE = 8, 2, 1
NEAR, STRICT, RELAXED = 1, 2, 4
#: A pair of names of one word, one of them shorter than this, allows one edit alone.
LONG_NAME = 8
GRAM = 3
FIELDS = ["bed", "civil_id", "name", "several", "gender", "age", "dx", "meds"]


def profile_columns() -> list[Column]:
    """Columns of a record (bed, civil_id, full_name, gender, age, dx, meds) as the rules compare them; blank ones are null."""
    some = lambda c: F.when(c != "", c)
    name = some(name_key(F.col("full_name")))
    return [
        some(bed_key(F.col("bed"))).alias("bed"), some(civil_id_key(F.col("civil_id"))).alias("civil_id"), name.alias("name"), F.trim("full_name").rlike("\\s").alias("several"),
        some(F.col("gender")).alias("gender"), F.col("age").cast("int").alias("age"), some(lexicon_key(F.col("dx"))).alias("dx"), some(lexicon_key(F.col("meds"))).alias("meds"),
    ]


def should_merge(a: dict[str, Column], b: dict[str, Column], distance: Column) -> Column:
    """Whether two profiles are one person's: the first rule that speaks decides. ``distance`` of the names is null beyond 4 edits."""
    both = lambda k: a[k].isNotNull() & b[k].isNotNull()
    same = lambda k: both(k) & (a[k] == b[k])
    missing = lambda k: a[k].isNull() | b[k].isNull()
    within = lambda k: both(k) & (F.contains(a[k], b[k]) | F.contains(b[k], a[k]))
    d = F.coalesce(distance, F.lit(99.0))
    gap = F.abs(a["age"] - b["age"])
    genders = missing("gender") | same("gender")
    tight = both("age") & (gap <= SAME_AGE) & genders
    partial = missing("name") | missing("bed")
    treated = (within("dx") & (within("meds") | missing("meds"))) | (within("meds") & (within("dx") | missing("dx")))
    several = a["several"] & b["several"]
    short = ~several & (F.least(F.length(a["name"]), F.length(b["name"])) < LONG_NAME)
    return (
        F.when(both("bed"), a["bed"] == b["bed"])
        .when(both("civil_id"), a["civil_id"] == b["civil_id"])
        .when(both("name") & (d <= NEAR) & (a["bed"].isNull() != b["bed"].isNull()) & genders, True)
        .when(~genders, False)
        .when(both("age") & (gap > FAR_AGE), False)
        .when(partial & tight & treated, True)
        .when(missing("name"), False)
        .when(d <= F.when(short, NEAR).otherwise(STRICT), True)
        .otherwise(~short & (missing("age") | (gap <= LIKE_AGE)) & (d <= RELAXED))
    )


def near_names(names: DataFrame, costs: DataFrame) -> DataFrame:
    """a, b and distance of all pairs of different names (name, several) that a rule could link, both ways, and of each with itself."""
    known = weighted.Costs.of(costs)
    folded = cut_lineage(names.select("name", known.fold(F.col("name")).alias("form"), (F.col("several") | (F.length("name") >= LONG_NAME)).alias("long")).groupBy("name", "form").agg(F.max("long").alias("long")))

    def within(rows: DataFrame, edits: int) -> DataFrame:
        forms = rows.select("form").distinct()
        met = fuzzy.segment_pairs(forms, "form", forms.withColumnRenamed("form", "other"), "other", edits).drop("distance")
        l, r = rows.select(F.col("name").alias("a"), "form"), rows.select(F.col("name").alias("b"), F.col("form").alias("other"))
        return met.join(l, "form").join(r, "other").where("a < b").select("a", "b", weighted.weighted_distance(F.col("a"), F.col("b"), known, float(edits)).alias("distance")).where("distance IS NOT NULL")

    pairs = within(folded, NEAR).unionByName(within(folded.where("long"), RELAXED)).groupBy("a", "b").agg(F.min("distance").alias("distance"))
    pairs = cut_lineage(pairs)
    itself = folded.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(0.0).alias("distance"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(itself)


def containing(texts: DataFrame) -> DataFrame:
    """inner and outer of all pairs of different values of ``texts`` (text) of which one holds the other, and of each with itself.

    The inner one looks for texts under its rarest gram of three characters (all of a shorter text is its gram).
    """
    once = cut_lineage(texts.select("text").where("text <> ''").distinct())
    n = F.length("text")
    grams = lambda w: F.transform(F.when(n >= w, F.sequence(F.lit(1), n - w + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring("text", i, w))
    every = once.select("text", F.explode(F.array_distinct(F.concat(*[grams(w) for w in range(1, GRAM + 1)]))).alias("gram"))
    counts = every.groupBy("gram").agg(F.count("*").alias("texts"))
    own = every.where(F.length("gram") == F.least(F.lit(GRAM), n)).join(counts, "gram")
    rarest = own.groupBy("text").agg(F.min(F.struct("texts", "gram")).alias("r")).select(F.col("text").alias("inner"), F.col("r.gram").alias("gram"))
    return rarest.join(every.withColumnRenamed("text", "outer"), "gram").where(F.contains("outer", "inner")).select("inner", "outer")


#: What the rules ask of bed and number where profiles share neither.
FLAGS = ["in_bed", "numbered", "gender"]
KIND = ["name", "several", *FLAGS]
ANY_AGE = -1


def flagged(profiles: DataFrame) -> DataFrame:
    return profiles.withColumns({"in_bed": F.col("bed").isNotNull(), "numbered": F.col("civil_id").isNotNull()})


def side(rows: DataFrame, p: str) -> DataFrame:
    return rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])


def members(classes: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """src and dst: each class with every row that has its columns, missing ones too."""
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"of_{c}").eqNullSafe(F.col(c))
    return side(classes, "of").join(rows, on).select(F.col("of_class").alias("src"), F.col("id").alias("dst"))


def apart() -> Column:
    """Whether classes a and b have profiles that share neither bed nor number; those that share one are linked by stars."""
    return ~(F.col("a_in_bed") & F.col("b_in_bed")) & ~(F.col("a_numbered") & F.col("b_numbered"))


def fields(p: str, known: dict[str, Column]) -> dict[str, Column]:
    """A class as a profile for the rules: what ``known`` tells, else the flags, else nothing."""
    out = {c: F.lit(None).cast("string") for c in FIELDS} | {"several": F.lit(False), "gender": F.col(f"{p}_gender")}
    return out | {"bed": F.when(F.col(f"{p}_in_bed"), p), "civil_id": F.when(F.col(f"{p}_numbered"), p)} | known


def name_links(profiles: DataFrame, costs: DataFrame) -> DataFrame:
    """src and dst: links by which all hangs together that rules link by names; about as many as profiles and ages of near names."""
    named = flagged(profiles.where("name IS NOT NULL")).select("id", *KIND, "age")
    classes = named.groupBy(*KIND, "age").agg(F.min("id").alias("class"))
    classes = cut_lineage(classes.withColumn("kind", F.min("class").over(Window.partitionBy(*KIND))))
    kinds = cut_lineage(classes.groupBy(*KIND).agg(F.min("kind").alias("kind"), F.min(F.when(F.col("age").isNull(), F.col("class"))).alias("ageless")))
    names = near_names(kinds.select("name", "several"), costs)
    met = side(kinds, "a").join(names, F.col("a_name") == F.col("a")).join(side(kinds, "b"), F.col("b_name") == F.col("b")).where(apart() & (F.col("a_kind") <= F.col("b_kind")))
    known = lambda p, age: {"name": F.col(f"{p}_name"), "several": F.col(f"{p}_several"), "age": F.lit(age)}
    gap = lambda years: should_merge(fields("a", known("a", 0)), fields("b", known("b", years)), F.col("distance"))
    reach = F.when(gap(FAR_AGE + 1), ANY_AGE).when(gap(FAR_AGE), FAR_AGE).when(gap(LIKE_AGE), LIKE_AGE)
    met = cut_lineage(met.select("a_kind", "b_kind", "a_ageless", "b_ageless", reach.alias("reach")).where("reach IS NOT NULL"))

    whole = met.where(F.col("reach") == ANY_AGE).select(F.col("a_kind").alias("src"), F.col("b_kind").alias("dst"))
    inner = classes.join(whole.select(F.explode(F.array("src", "dst")).alias("kind")).distinct(), "kind").select(F.col("kind").alias("src"), F.col("class").alias("dst"))
    # A missing age goes with any; others with the nearest below and above.
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a_kind").alias("kind"), F.col("b_ageless").alias("ageless")), F.struct(F.lit(1).alias("side"), F.col("b_kind").alias("kind"), F.col("a_ageless").alias("ageless"))))
    ages = met.where(F.col("reach") != ANY_AGE).select("a_kind", "b_kind", "reach", sides.alias("s")).select("a_kind", "b_kind", "reach", "s.*").join(classes.select("kind", "age", "class"), "kind")
    pair = Window.partitionBy("a_kind", "b_kind")

    def next_one(*order: Column) -> Column:
        w = pair.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = lambda s: F.last(F.when((F.col("side") == s) & F.col("age").isNotNull(), F.struct("age", "class")), ignorenulls=True).over(w)
        return F.when(F.col("side") == 0, last(1)).otherwise(last(0))

    near = ages.select("class", "age", "ageless", "reach", next_one(F.asc("age"), F.asc("side")).alias("below"), next_one(F.desc("age"), F.desc("side")).alias("above"))
    within = lambda c: F.when(F.abs(F.col("age") - F.col(f"{c}.age")) <= F.col("reach"), F.col(f"{c}.class"))
    aged = near.select(F.col("class").alias("src"), F.explode(F.array_compact(F.array(within("below"), within("above"), F.col("ageless")))).alias("dst"))
    links = cut_lineage(whole.unionByName(inner).unionByName(aged).distinct())
    touched = classes.join(links.select(F.explode(F.array("src", "dst")).alias("class")).distinct(), "class", "left_semi").drop("kind")
    return links.unionByName(members(touched, named, [*KIND, "age"]))


def aged_links(left: DataFrame, right: DataFrame, met: DataFrame) -> DataFrame:
    """src and dst: links by which all hangs together of ``left`` and ``right`` (id, group, text, flags, age) whose texts ``met`` (a, b) pairs and whose rest the rules allow.

    Classes whose profiles are all of one group need none.
    """
    by = ["text", *FLAGS, "age"]

    def classes(rows: DataFrame, p: str) -> DataFrame:
        return side(cut_lineage(rows.groupBy(*by).agg(F.min("id").alias("class"), F.min("group").alias("low"), F.max("group").alias("high"))), p)

    a, b = classes(left, "a"), classes(right, "b")
    alike = lambda p: fields(p, {"age": F.col(f"{p}_age"), "dx": F.lit("x"), "meds": F.lit("x")})
    years = a.join(met, F.col("a_text") == F.col("a")).withColumn("years", F.explode(F.sequence(F.col("a_age") - SAME_AGE, F.col("a_age") + SAME_AGE)))
    parted = (F.col("a_low") != F.col("a_high")) | (F.col("b_low") != F.col("b_high")) | (F.col("a_low") != F.col("b_low"))
    pairs = years.join(b, (F.col("b") == F.col("b_text")) & (F.col("years") == F.col("b_age"))).where(parted & apart() & should_merge(alike("a"), alike("b"), F.lit(None).cast("double")))
    links = cut_lineage(pairs.select(F.col("a_class").alias("src"), F.col("b_class").alias("dst")).distinct())
    out = links
    for rows, p, end, seen in ((left, "a", "src", a), (right, "b", "dst", b)):
        touched = seen.join(links.select(F.col(end).alias(f"{p}_class")).distinct(), f"{p}_class", "left_semi").select(*[F.col(f"{p}_{c}").alias(c) for c in ("class", *by)])
        out = out.unionByName(members(touched, rows, by))
    return out


def joined(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """id and group of all profiles over the edges."""
    return merge_groups(profiles.select("id"), "id", edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct())


def link(records: DataFrame, key: str, costs: DataFrame) -> DataFrame:
    """key and group, the least key of all records that chains of the rules connect.

    records: key, bed, civil_id, full_name, gender, age, dx, meds; missing means null or blank, a name without letters is
    missing. costs: what characters cost (a, b, cost) in names; an empty table counts plain edits. Records that repeat wholly
    are linked if the rules link two such records, or if both are linked with a third. Null keys take no part.
    """
    rows = cut_lineage(fuzzy.spread(records.where(F.col(key).isNotNull()), key).select(F.col(key).alias("key"), *profile_columns()))
    alone = rows.groupBy(*FIELDS).agg(F.min("key").alias("id"))
    profiles = cut_lineage(alone)

    bed = stars(profiles.where("bed IS NOT NULL"), ["bed"], "id")
    # Of one number, those without a bed go with all; without any such, only those of one bed belong together.
    open_numbers = profiles.where("civil_id IS NOT NULL AND bed IS NULL").select("civil_id").distinct()
    number = stars(profiles.join(open_numbers, "civil_id", "left_semi"), ["civil_id"], "id")
    by_name = name_links(profiles, costs)

    # One of both lacks a bed (different beds never merge), so one is partly known; ages are at most one apart.
    aged = flagged(profiles.where("age IS NOT NULL")).withColumn("group", F.col("id"))
    rows_of = lambda p, text, where: p.where(where).select("id", "group", F.col(text).alias("text"), *FLAGS, "age")
    held, treated = {}, []
    for what, other in (("dx", "meds"), ("meds", "dx")):
        one = containing(aged.select(F.col(what).alias("text"))).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
        held[what] = cut_lineage(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        # Where one has no other treatment, the other's doesn't matter.
        treated.append(aged_links(rows_of(aged, what, f"{what} IS NOT NULL AND {other} IS NULL"), rows_of(aged, what, f"{what} IS NOT NULL"), held[what]))
    edges = cut_lineage(bed.unionByName(number).unionByName(by_name).unionByName(treated[0]).unionByName(treated[1]).where("src <> dst").distinct())
    groups = joined(profiles, edges)

    # Both treatments of both: only what the groups so far don't have together is paired.
    both = cut_lineage(aged.where("dx IS NOT NULL AND meds IS NOT NULL").drop("group").join(groups, "id"))
    texts = both.groupBy("dx", "meds").agg(F.min("id").alias("text"), F.min("group").alias("low"), F.max("group").alias("high"))
    texts = cut_lineage(texts)
    near = side(texts, "a").join(held["dx"].toDF("a_dx", "b_dx"), "a_dx").join(held["meds"].toDF("a_meds", "b_meds"), "a_meds").join(side(texts, "b"), ["b_dx", "b_meds"])
    near = near.where("a_text <= b_text AND (a_low <> a_high OR b_low <> b_high OR a_low <> b_low)").select(F.col("a_text").alias("a"), F.col("b_text").alias("b"))
    told = both.join(texts.select("dx", "meds", "text"), ["dx", "meds"])
    late = cut_lineage(aged_links(rows_of(told, "text", "true"), rows_of(told, "text", "true"), near).where("src <> dst").distinct())
    edges, known = edges.unionByName(late), groups.toDF("id", "known")
    between = late.join(known.toDF("src", "a"), "src").join(known.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    between = cut_lineage(between)
    merged = joined(between.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), between).toDF("known", "merged")
    groups = known.join(merged, "known", "left").select("id", F.coalesce("merged", "known").alias("group"))

    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("touched", F.lit(True))
    own = {c: F.col(c) for c in FIELDS}
    told = profiles.join(groups, "id").join(touched, "id", "left").select(*[F.col(c).alias(f"p_{c}") for c in FIELDS], "group", (should_merge(own, own, F.when(F.col("name").isNotNull(), 0.0)) | F.coalesce("touched", F.lit(False))).alias("one"))
    on = F.lit(True)
    for c in FIELDS:
        on = on & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return rows.join(told, on).select(F.col("key").alias(key), F.when(F.col("one"), F.col("group")).otherwise(F.col("key")).alias("group"))
