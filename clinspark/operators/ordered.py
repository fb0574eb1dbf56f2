"""Ordered operators: fill-down, look-back, islands, lanes, hash chains, and folds over a document's words."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_down(table: DataFrame, group: str, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The last value that isn't null, up to and with each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.withColumn(out, F.last(value, ignorenulls=True).over(w))


def look_back(table: DataFrame, group: str, order: Sequence[str], condition: Column, reach: int, out: str) -> DataFrame:
    """Whether any of the ``reach`` rows before meets the condition."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-reach, -1)
    return table.withColumn(out, F.coalesce(F.max(F.coalesce(condition, F.lit(False)).cast("int")).over(w), F.lit(0)) == 1)


def islands(table: DataFrame, group: str, order: Sequence[str], starts: Column, out: str) -> DataFrame:
    """A number for each run of rows that begins where ``starts`` holds (windows allowed in it)."""
    w = Window.partitionBy(group).orderBy(*order)
    return table.withColumn("__s", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(out, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def chain(table: DataFrame, group: str, order: Sequence[str], payload: Sequence[str], prev: str = "prev_hash", own: str = "record_hash", genesis: str = "GENESIS") -> DataFrame:
    """Content hashes, each linked to the content hash of the row before it."""
    body = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload])
    w = Window.partitionBy(group).orderBy(*order)
    hashed = table.withColumn(own, F.sha2(body, 256))
    return hashed.withColumn(prev, F.coalesce(F.lag(own).over(w), F.lit(genesis)))


def verify_chain(table: DataFrame, group: str, order: Sequence[str], payload: Sequence[str], prev: str = "prev_hash", own: str = "record_hash", genesis: str = "GENESIS") -> DataFrame:
    """The rows with content_ok and link_ok: whether hash and link are those of the stored rows."""
    body = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in payload])
    w = Window.partitionBy(group).orderBy(*order)
    return table.withColumns({"content_ok": F.col(own).eqNullSafe(F.sha2(body, 256)), "link_ok": F.col(prev).eqNullSafe(F.coalesce(F.lag(own).over(w), F.lit(genesis)))})


def lanes(words: DataFrame, doc: str, cx: str, width: str, min_side: int = 4) -> DataFrame:
    """doc and split: the middle of the largest horizontal gap, if it is wide enough and both sides have words."""
    w = Window.partitionBy(doc).orderBy(cx)
    gaps = words.withColumns({"before": F.lag(cx).over(w), "i": F.row_number().over(w)})
    size = words.groupBy(doc).agg(F.count("*").alias("n"), F.avg(width).alias("avg_w"), (F.max(cx) - F.min(cx)).alias("span"))
    best = gaps.groupBy(doc).agg(F.max(F.struct((F.col(cx) - F.col("before")).alias("gap"), (-F.col("i")).alias("i"), ((F.col(cx) + F.col("before")) / 2).alias("split"))).alias("g"))
    return best.join(size, doc).where((F.col("g.gap") > F.greatest(3.2 * F.col("avg_w"), 0.12 * F.col("span"))) & (-F.col("g.i") - 1 >= min_side) & (F.col("n") + F.col("g.i") + 1 >= min_side)).select(doc, F.col("g.split").alias("split"))


def bands(values: Sequence[float], limit: float) -> list[int]:
    """Band numbers of ascending values; a band ends where a value is over ``limit`` from its running mean."""
    out: list[int] = []
    band, total, n = 0, 0.0, 0
    for v in values:
        if n and abs(v - total / n) > limit:
            band, total, n = band + 1, 0.0, 0
        total, n = total + v, n + 1
        out.append(band)
    return out


def row_bands(words: DataFrame, doc: str = "doc_id", cx: str = "cx", cy: str = "cy", height: str = "h", least: float = 16.0, share: float = 0.82) -> DataFrame:
    """``words`` with row_id: rows of text by a running mean of their middles. One document is one group."""
    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([cy, cx], kind="stable")
        return rows.assign(row_id=bands(rows[cy].tolist(), max(least, share * rows[height].mean())))

    return words.groupBy(doc).applyInPandas(fold, _with(words, "row_id int"))


def _with(table: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields), more])


def dbscan(points: DataFrame, key: str, x: str, y: str, eps: float, group: str, keep_singletons: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links of points within ``eps`` in a group, by cells of that size (and what rounding may add) so that only neighbouring cells meet; and the nodes.

    A point without a neighbour is noise, unless singletons are kept.
    """
    size = eps * (1 + 1e-9)
    cell = points.withColumns({"__i": F.floor(F.col(x) / size), "__j": F.floor(F.col(y) / size)})
    around = cell.withColumn("__d", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])))
    left = around.select(F.col(group).alias("g"), F.col(key).alias("src"), F.col(x).alias("x1"), F.col(y).alias("y1"), (F.col("__i") + F.col("__d.a")).alias("i"), (F.col("__j") + F.col("__d.b")).alias("j"))
    right = cell.select(F.col(group).alias("g"), F.col(key).alias("dst"), F.col(x).alias("x2"), F.col(y).alias("y2"), F.col("__i").alias("i"), F.col("__j").alias("j"))
    near = left.join(right, ["g", "i", "j"]).where((F.col("src") < F.col("dst")) & (F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2) <= eps * eps)).select("src", "dst")
    nodes = points.select(key) if keep_singletons else near.select(F.explode(F.array("src", "dst")).alias(key)).distinct()
    return near, nodes


def records_from_words(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Words with entity, text, confidence and a row to one record for each row: the surest value of each entity.

    Names are read row by row from left to right; a row without a bed or a name goes to the record before it. Of several
    beds or ages of a record's rows the first row's stays.
    """
    per_row = words.groupBy(doc, "row_id").agg(
        F.max_by(F.when(F.col("entity") == "BED", F.col("text")), F.when(F.col("entity") == "BED", F.col("confidence"))).alias("bed"),
        F.max_by(F.when(F.col("entity") == "AGE_GENDER", F.col("text")), F.when(F.col("entity") == "AGE_GENDER", F.col("confidence"))).alias("age_gender"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("entity") == "NAME", F.struct("cx", "text")))), lambda s: s["text"]).alias("names"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("entity") == "DIAGNOSIS", F.struct("cx", "text")))), lambda s: s["text"]).alias("dx"),
    )
    anchored = islands(per_row, doc, ["row_id"], F.col("bed").isNotNull() | (F.size("names") > 0), "record_id")
    rows = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row_id", c))), lambda r: r[c]))
    top = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(c)
    return anchored.groupBy(doc, "record_id").agg(top("bed"), top("age_gender"), F.array_join(rows("names"), " ").alias("name"), rows("dx").alias("dx"))
