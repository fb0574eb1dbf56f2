"""Boxes to rows and columns: splitting detections, column bands and roles, relabelling, anchors, row profiles, fusion."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinspark.operators.ordered import _with, bands

#: What each kind of entity says about a row being a record of its own.
IDENTITY = {"BED": 1.2, "NAME": 1.05, "AGE_GENDER": 1.0, "AGE": 0.3, "GENDER": 0.25, "CIVIL_ID": 0.6, "TRIAGE": 0.18, "DIAGNOSIS": 0.2}
ROLES = {"BED": "bed", "NAME": "name", "AGE_GENDER": "age", "AGE": "age", "GENDER": "age", "DIAGNOSIS": "dx", "MEDICATION": "meds", "TRIAGE": "triage", "ASSIGNED_DOCTOR": "doctor", "WARD": "ward", "STATUS": "status"}
#: Header words of a table, by the role of the column beneath.
HEADERS = (("bed", "^(bed|room|rm)( ?(no|number|#))?$"), ("name", "^(patient( name)?|name)$"), ("age", "^(age|sex|age ?/ ?sex|gender)$"), ("dx", "^(dx|diagnosis|problem)s?$"), ("meds", "^(meds|medications?|treatment)$"), ("doctor", "^(dr|doctor|consultant|physician)$"), ("status", "^(status|code)$"))


def split_detections(words: DataFrame, text: str = "text") -> DataFrame:
    """A box for each pipe cell and word; a part's box is as wide as its share of the characters."""
    parts = F.filter(F.split(F.col(text), "[|\\s]+"), lambda x: x != "")
    at = words.withColumn("__parts", parts).withColumn("__n", F.greatest(F.length(text), F.lit(1)))
    out = at.select("*", F.posexplode("__parts").alias("part", "__t"))
    before = F.aggregate(F.slice("__parts", F.lit(1), F.col("part")), F.lit(0), lambda a, p: a + F.length(p) + 1)
    w = F.length("__t") / F.col("__n") * F.col("w")
    x = F.col("x") + F.least(before / F.col("__n"), F.lit(1.0)) * F.col("w")
    kept = [c for c in words.columns if c not in (text, "x", "w", "cx")]
    return out.select(*kept, "part", F.col("__t").alias(text), x.alias("x"), w.alias("w"), (x + w / 2).alias("cx"))


def entity_role(entity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in ROLES.items() for v in kv]), entity)


def header_role(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(r)) for r, p in HEADERS])


def column_bands(words: DataFrame, doc: str = "doc_id", cx: str = "cx", width: str = "w", least: float = 24.0, share: float = 1.05) -> DataFrame:
    """``words`` with column_id: columns by a running mean of their middles. One document is one group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([cx], kind="stable")
        return rows.assign(column_id=bands(rows[cx].tolist(), max(least, share * rows[width].mean())))

    return words.groupBy(doc).applyInPandas(fold, _with(words, "column_id int"))


def column_roles(words: DataFrame, doc: str = "doc_id", confidence: str = "confidence", least: float = 0.52) -> DataFrame:
    """doc, column_id and the role of most weight, if that is enough; ties to the lesser name."""
    votes = words.withColumn("role", entity_role(F.col("entity"))).where("role IS NOT NULL").groupBy(doc, "column_id", "role").agg(F.sum(confidence).alias("weight"))
    w = Window.partitionBy(doc, "column_id").orderBy(F.desc("weight"), "role")
    return votes.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) & (F.col("weight") >= least)).drop("__r")


def identity_scores(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, row_id, identity (each kind of entity once), and the row's profile."""
    score = F.lit(0.0)
    for e, v in IDENTITY.items():
        score = score + F.coalesce(F.max(F.when(F.col("entity") == e, v)), F.lit(0.0))
    return words.groupBy(doc, "row_id").agg(score.alias("identity"), F.count("*").alias("n"), F.min("x").alias("leftmost"), F.avg("cy").alias("centre_y"), F.array_sort(F.collect_set(entity_role(F.col("entity")))).alias("roles"))


def nearest_anchor(words: DataFrame, anchors: DataFrame, doc: str = "doc_id", x_weight: float = 0.3, y_weight: float = 1.0) -> DataFrame:
    """Each word's nearest anchor of its document by weighted distance; ties to the lesser anchor."""
    a = anchors.select(F.col(doc), F.col("anchor"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    d = F.sqrt(F.pow((F.col("cx") - F.col("ax")) * x_weight, 2) + F.pow((F.col("cy") - F.col("ay")) * y_weight, 2))
    return words.join(a, doc).withColumn("distance", d).groupBy(doc, "word_id").agg(F.min(F.struct("distance", "anchor")).alias("b")).select(doc, "word_id", F.col("b.anchor").alias("anchor"), F.col("b.distance").alias("distance"))


def relabel(rows: pd.DataFrame) -> pd.DataFrame:
    """Unknown words by their neighbours, from left to right; later words see what earlier ones have become."""
    rows = rows.sort_values("cx", kind="stable")
    kind, sure, text, cx = (rows[c].tolist() for c in ("entity", "confidence", "text", "cx"))
    live = [i for i, k in enumerate(kind) if k not in ("NOISE", "HEADER")]
    place = {k: next((cx[i] for i in live if kind[i] == k), None) for k in ("BED", "AGE_GENDER")}
    for at, i in enumerate(live):
        before = kind[live[at - 1]] if at else None
        after = kind[live[at + 1]] if at + 1 < len(live) else None
        letters = len(text[i]) >= 2 and text[i].isalpha()
        if kind[i] == "UNKNOWN":
            floor = 0.0
            if before == "BED":
                floor = 0.7 if after == "AGE_GENDER" else 0.55
            elif before == "NAME" and letters:
                floor = 0.52
            elif letters and None not in place.values() and place["BED"] < cx[i] < place["AGE_GENDER"]:
                floor = 0.65
            if floor:
                kind[i], sure[i] = "NAME", max(sure[i], floor)
        if kind[i] == "NAME" and sure[i] < 0.55 and before == "DIAGNOSIS":
            kind[i], sure[i] = "DIAGNOSIS", sure[live[at - 1]] * 0.8
    return rows.assign(entity=kind, confidence=sure)


def relabel_rows(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """:func:`relabel` for each row of each document; a row is a bounded group."""
    return words.groupBy(doc, "row_id").applyInPandas(relabel, words.schema)


def fuse_boxes(pairs: DataFrame, iou: str = "iou", limit: float = 0.55) -> DataFrame:
    """Overlaps that may fuse two recognisers' words; matching one to one is :func:`records.one_to_one`'s task."""
    return pairs.where(F.col(iou) >= limit)


def fingerprint(columns: Sequence[str]) -> Column:
    """A word's place and text, rounded, as a key: what coverage counts."""
    return F.concat_ws("|", *[F.round(F.col(c)).cast("long").cast("string") if c != "text" else F.upper(F.regexp_replace(F.col(c), "\\s+", "")) for c in columns])


def gap_epsilon(words: DataFrame, doc: str = "doc_id", cy: str = "cy", factor: float = 2.5, low: float = 20.0, high: float = 120.0) -> DataFrame:
    """doc and eps: the upper median of vertical gaps, times a factor, clamped."""
    w = Window.partitionBy(doc).orderBy(cy)
    gaps = words.select(doc, cy).distinct().withColumn("gap", F.col(cy) - F.lag(cy).over(w)).where("gap > 0")
    ranked = gaps.withColumns({"i": F.row_number().over(Window.partitionBy(doc).orderBy("gap")), "n": F.count("*").over(Window.partitionBy(doc))})
    return ranked.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select(doc, F.least(F.greatest(F.col("gap") * factor, F.lit(low)), F.lit(high)).alias("eps"))
