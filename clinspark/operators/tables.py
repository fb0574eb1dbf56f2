"""Sheets with a header row: columns from header cells, words to columns, rows to records; scores of names and diagnoses."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.functions.scalar import clamp
from clinspark.operators.layout import IDENTITY, ROLES, header_role
from clinspark.operators.ordered import bands

#: Roles that carry on a record that another row has begun.
CONTINUING = frozenset({"dx", "meds", "triage", "status", "doctor", "ward"})


def header_rows(words: DataFrame, doc: str = "doc_id", first: int = 6) -> DataFrame:
    """doc and header_row: of the first rows the one with most header words, two different roles at least; ties to the earlier."""
    cells = words.where(F.col("row_id") < first).withColumn("role", header_role(F.col("text")))
    scored = cells.groupBy(doc, "row_id").agg(F.count_distinct("role").alias("roles"), F.count("role").alias("cells")).where("roles >= 2")
    best = scored.groupBy(doc).agg(F.max(F.struct((F.col("roles") * 1.5 + F.col("cells") * 0.35).alias("score"), (-F.col("row_id")).alias("r"))).alias("b"))
    return best.select(doc, (-F.col("b.r")).alias("header_row"))


def merge_columns(cells: pd.DataFrame, reach: float = 72.0) -> pd.DataFrame:
    """Neighbouring cells of one role are one column: the middle moves half way, support adds up."""
    out: list[list] = []
    for role, x, sure in cells.sort_values("cx", kind="stable")[["role", "cx", "confidence"]].itertuples(index=False):
        if out and out[-1][0] == role and abs(out[-1][1] - x) <= reach:
            last = out[-1]
            last[1], last[2], last[3] = (last[1] + x) / 2, last[2] + 1, max(last[3], sure)
        else:
            out.append([role, float(x), 1, float(sure)])
    return pd.DataFrame(out, columns=["role", "centre", "support", "confidence"])


def header_columns(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, role, centre, support and confidence of the columns under each document's header."""
    cells = words.join(header_rows(words, doc), doc).where("row_id = header_row").withColumn("role", header_role(F.col("text"))).where("role IS NOT NULL").select(doc, "role", "cx", "confidence")
    kind = dict(words.dtypes)[doc]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return merge_columns(rows).assign(**{doc: rows[doc].iat[0]})[[doc, "role", "centre", "support", "confidence"]]

    return cells.groupBy(doc).applyInPandas(fold, f"{doc} {kind}, role string, centre double, support int, confidence double")


def project_to_columns(words: DataFrame, columns: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Words below the header with the role of the nearest column; ties to the column further left.

    Columns of a document are few, so each word meets only its own document's.
    """
    below = words.join(header_rows(words, doc), doc).where("row_id > header_row").drop("header_row")
    packed = columns.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("centre", "role"))).alias("__c"))
    nearest = F.array_min(F.transform("__c", lambda c: F.struct(F.abs(c["centre"] - F.col("cx")).alias("d"), c["centre"].alias("x"), c["role"].alias("role"))))
    return below.join(packed, doc).withColumn("role", nearest["role"]).drop("__c")


def section_row(roles: Column, header_cells: Column, n: Column) -> Column:
    """A row that belongs to no record: mostly header words, or banners alone."""
    anchored = F.exists(roles, lambda r: r.isin("bed", "name", "age", "dx", "meds"))
    return ~anchored & ((header_cells >= F.greatest(F.lit(1), F.ceil(n / 2))) | (F.size(roles) > 0))


def continues(before: dict, row: dict, first_column: float, height: float) -> bool:
    """Whether a row carries on the record of the row before it."""
    if before is None or row["hard"] or abs(row["y"] - before["y"]) > max(34.0, 1.75 * height):
        return False
    roles = set(row["roles"])
    if roles and roles <= CONTINUING:
        return True
    right = row["left"] > first_column + max(28.0, 1.35 * height)
    if not row["soft"] and len(roles) <= 2 and (roles & {"dx", "meds"} or right):
        return True
    return right and (roles == {"name"} or row["identity"] < 0.65)


def records_of_table(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``words`` (row_id, role, entity, boxes) with record_id: rows that carry on join the record before them.

    A fold over one document's rows, since each answer changes what the next row is held against.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_id", "cx"], kind="stable")
        left, height = rows["x"].min(), rows["h"].mean()
        number, before, out = -1, None, {}
        for row_id, part in rows.groupby("row_id", sort=True):
            kinds = set(part["entity"])
            now = {"y": part["cy"].mean(), "left": part["x"].min(), "roles": [r for r in part["role"].dropna().unique()], "hard": bool(kinds & {"BED", "CIVIL_ID"}), "soft": "NAME" in kinds, "identity": sum(v for k, v in IDENTITY.items() if k in kinds)}
            if not continues(before, now, left, height):
                number += 1
            out[row_id], before = max(number, 0), now
        return rows.assign(record_id=rows["row_id"].map(out).astype("int32"))

    return words.groupBy(doc).applyInPandas(fold, f"{kind}, record_id int")


def split_cluster(rows: pd.DataFrame) -> pd.DataFrame:
    """A cluster of over four words with two or more strong rows falls apart; weak rows stay with the row before."""
    rows = rows.sort_values(["cy", "cx"], kind="stable")
    if len(rows) <= 4:
        return rows.assign(part=0)
    band = bands(rows["cy"].tolist(), max(0.8 * rows["h"].mean(), 18.0))
    score = rows.assign(b=band).groupby("b")["entity"].agg(lambda e: sum(v for k, v in IDENTITY.items() if k in set(e)))
    if (score >= 1.2).sum() < 2:
        return rows.assign(part=0)
    part, number = {}, -1
    for b, s in score.items():
        if number < 0 or s >= 0.6:
            number += 1
        part[b] = number
    return rows.assign(part=[part[b] for b in band])


# --- scores of texts ---------------------------------------------------------------------------------------------------


def name_score(text: Column, known: Column, clinical: Column) -> Column:
    """How much a text looks like a name: words of letters, up to four; known names score high, clinical words nothing."""
    words = F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != "")
    fine = F.forall(words, lambda w: w.rlike("^[A-Za-z؀-ۿ][A-Za-z؀-ۿ'’-]*$"))
    many = F.size(words) >= 2
    listed = F.exists(words, lambda w: F.array_contains(known, F.lower(w)))
    hits = F.size(F.filter(words, lambda w: F.array_contains(clinical, F.lower(w))))
    capital = F.exists(words, lambda w: w.rlike("^[A-Z]"))
    return (
        F.when(F.coalesce(F.length(F.trim(text)), F.lit(0)) < 2, 0.0)
        .when(~fine | (F.size(words) > 4), 0.0)
        .when((hits >= F.greatest(F.lit(1), F.ceil(F.size(words) / 2))) & ~listed, 0.0)
        .when(listed, F.when(many, 0.95).otherwise(0.84))
        .when(text.rlike("[؀-ۿ]"), F.when(many, 0.82).otherwise(0.68))
        .when(many & (capital | (text == F.lower(text))), 0.66)
        .when(~many & text.rlike("^([A-Z][a-z]{2,20}|[a-z]{3,20})$"), 0.52)
        .otherwise(0.0)
    )


def diagnosis_score(confidence: Column, terms: Column, details: Column, connectors: Column, starts: Column, slash: Column, several: Column) -> Column:
    """Weighted evidence: terms and details count up to three, connectors up to two; nothing without a term."""
    up_to = lambda c, n: F.least(c, F.lit(n))
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    score = 0.48 + 0.22 * confidence + 0.09 * up_to(terms, 3) + 0.06 * up_to(details, 3) + 0.02 * up_to(connectors, 2) + flag(starts, 0.08) + flag(slash, 0.07) + flag(several, 0.08)
    return F.when(terms > 0, clamp(score, 0.0, 1.0)).otherwise(0.0)


def disambiguate(text: Column, context: Column, senses: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The sense with most clues in its context; ties to the earlier one, none to the default."""
    low = F.lower(F.coalesce(context, F.lit("")))
    counted = F.array(*[F.struct(sum((F.contains(low, F.lit(c)).cast("int") for c in clues), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("sense")) for i, (name, clues) in enumerate(senses)])
    best = F.array_max(counted)
    return F.when(text.isNotNull(), F.when(best["n"] > 0, best["sense"]).otherwise(default))


def learned_label(corrections: Column, name: Column, dx: Column, med: Column) -> Column:
    """What learned counts say of an unknown word, in order: corrected twice, then name, diagnosis, medication."""
    return F.when(corrections >= 2, "CORRECTED").when(name >= 0.7, "NAME").when(dx >= 0.6, "DIAGNOSIS").when(med >= 0.6, "MEDICATION").otherwise("UNKNOWN")


def strong_identity(name: Column, bed: Column, age: Column, civil_id: Column) -> Column:
    """Two identifiers at least."""
    return sum((c.isNotNull().cast("int") for c in (name, bed, age, civil_id)), F.lit(0)) >= 2


def adds_detail(kept: Sequence[Column], other: Sequence[Column]) -> Column:
    """Whether the other record knows a field that the kept one lacks."""
    out = F.lit(False)
    for a, b in zip(kept, other, strict=True):
        out = out | (a.isNull() & b.isNotNull())
    return out


def lagged_lines(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc and lagged: a roster whose clinical details sit one line early.

    lines: doc, line, has_identity, has_clinical. The first line has details alone, the last one identity alone, those
    between both, and there are three at least.
    """
    w = Window.partitionBy(doc)
    at = lines.withColumns({"lo": F.min("line").over(w), "hi": F.max("line").over(w)})
    first, last = F.col("line") == F.col("lo"), F.col("line") == F.col("hi")
    fits = F.when(first, ~F.col("has_identity") & F.col("has_clinical")).when(last, F.col("has_identity") & ~F.col("has_clinical")).otherwise(F.col("has_identity") & F.col("has_clinical"))
    return at.groupBy(doc).agg((F.bool_and(fits) & (F.count("*") >= 3)).alias("lagged"))


def repair_lag(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines with the clinical part of the line before, where the roster lags; others as they are.

    lines: doc, line, identity, clinical. A line that then has no identity goes.
    """
    flags = lagged_lines(lines.select(doc, "line", F.col("identity").isNotNull().alias("has_identity"), F.col("clinical").isNotNull().alias("has_clinical")), doc)
    w = Window.partitionBy(doc).orderBy("line")
    moved = lines.join(flags, doc).withColumn("clinical", F.when(F.col("lagged"), F.lag("clinical").over(w)).otherwise(F.col("clinical")))
    return moved.where(~F.col("lagged") | F.col("identity").isNotNull()).drop("lagged")


def role_of(entity: str) -> str | None:
    return ROLES.get(entity)
