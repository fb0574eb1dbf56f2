"""Edit distances that know which characters recognisers mix up, as Arrow UDFs behind an exact native lower bound."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.functions.scalar import CONFUSABLE_FROM, CONFUSABLE_TO, canonical_token

#: The first character that stands for a word.
FIRST = 0x4E00
#: A substitution within a group of confusable characters costs this much, any other edit 1.
GROUP_COST = 0.18


@lru_cache(maxsize=1)
def _groups() -> dict[str, str]:
    groups = dict(zip(CONFUSABLE_FROM, CONFUSABLE_TO, strict=True))
    return groups | {c: c for c in CONFUSABLE_TO}


def weighted_distance(a: str | None, b: str | None, pair_costs: Mapping[tuple[str, str], float] | None = None) -> float | None:
    """Edits from a to b; substitutions cost what the table says for the pair in either order.

    Without a table, characters of one confusable group cost ``GROUP_COST``, case ignored. Null if either side is null.
    """
    if a is None or b is None:
        return None
    if pair_costs is None:
        g = _groups()
        a, b = a.upper(), b.upper()
        cost = lambda x, y: GROUP_COST if x in g and g.get(x) == g.get(y) else 1.0
    else:
        a, b = a.lower(), b.lower()
        cost = lambda x, y: pair_costs.get((min(x, y), max(x, y)), 1.0)
    above = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            swap = above[j - 1] + (0.0 if x == y else cost(x, y))
            row.append(min(above[j] + 1, row[j - 1] + 1, swap))
        above = row
    return above[-1]


#: Cells of a table of distances that are worked on at a time.
STEP_CELLS = 1 << 22


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, a row each, and their lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, dtype=np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out, lengths


def _table(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of pairs, all pairs' tables filled in step."""
    x, n = _codes(a)
    y, m = _codes(b)
    g = _groups()
    known, ranks = np.array([ord(c) for c in g], dtype=np.int64), np.array([ord(v) for v in g.values()], dtype=np.int64)
    order = np.argsort(known)
    known, ranks = known[order], ranks[order]

    def group(codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, ranks[at], -1)

    gx, gy = group(x), group(y)
    above = np.broadcast_to(np.arange(y.shape[1] + 1, dtype=float), (len(a), y.shape[1] + 1)).copy()
    out = np.where(n == 0, m.astype(float), 0.0)
    rows = np.arange(len(a))
    for i in range(x.shape[1]):
        row = np.empty_like(above)
        row[:, 0] = i + 1
        alike = (gx[:, i, None] == gy) & (gy >= 0)
        swap = above[:, :-1] + np.where(x[:, i, None] == y, 0.0, np.where(alike, GROUP_COST, 1.0))
        best = np.minimum(above[:, 1:] + 1, swap)
        for j in range(y.shape[1]):
            row[:, j + 1] = np.minimum(best[:, j], row[:, j] + 1)
        above = row
        last = n == i + 1
        out[last] = above[rows[last], m[last]]
    return out


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`weighted_distance` without a table, for all pairs of a batch at once."""
    out = np.full(len(a), np.nan)
    there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    x, y = ([t.upper() for t in s.to_numpy()[there]] for s in (a, b))
    cells = np.array([(len(p) + 1) * (len(q) + 1) for p, q in zip(x, y, strict=True)], dtype=np.int64)
    order = np.argsort(cells, kind="stable")  # pairs of about one size together
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * cells[order[hi]] <= STEP_CELLS:
            hi += 1
        some = order[lo:hi]
        out[there[some]] = _table([x[i] for i in some], [y[i] for i in some])
        lo = hi
    return pd.Series(out).where(~np.isnan(out), None).astype("float64")


def ocr_distance(a: Column, b: Column) -> Column:
    """:func:`weighted_distance` over Arrow batches."""
    return F.pandas_udf(_distances, "double")(a, b)


def learned_costs(counts: Mapping[tuple[str, str], int], base: float = 1.0) -> dict[tuple[str, str], float]:
    """Costs that fall with the number of times a confusion was confirmed; keys in sorted order, so both directions count.

    Below ten confirmations in all nothing has been learned; from a hundred on the base cost plays no part.
    """
    import math

    total: dict[tuple[str, str], int] = {}
    for (x, y), n in counts.items():
        k = (min(x.lower(), y.lower()), max(x.lower(), y.lower()))
        total[k] = total.get(k, 0) + n
    everything = sum(total.values())
    if everything < 10:
        return {}
    trust = min(everything / 100, 1.0)
    return {k: (1 - trust) * base + trust * (base * math.exp(-n / 10) + 0.05) for k, n in total.items()}


def lower_bound(a: Column, b: Column) -> Column:
    """Never more than :func:`ocr_distance`: inside a group edits are free here, outside they cost the same."""
    return F.levenshtein(canonical_token(a), canonical_token(b))


def within(left: Column, right: Column, limit: float) -> Column:
    """Whether the distance is at most the limit; the native bound goes first."""
    return (F.abs(F.length(left) - F.length(right)) <= limit) & (lower_bound(left, right) <= limit)


def word_error_rate(pairs: DataFrame, predicted: str, reference: str, out: str = "wer") -> DataFrame:
    """``pairs`` with edits between word sequences over the reference's words.

    Words become single characters by their place in the sorted list of both texts' words, so that the native edit
    distance counts words. Characters start at ``FIRST`` and leave the surrogates out: a pair may have about a million
    different words. A null text counts as empty; a reference without words has rate 1 if the prediction has any, else 0.
    """
    words = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.col(c)), "[ \\t\\r\\n]+", " ")), " "), lambda x: x != "")
    p, r = F.coalesce(words(predicted), F.array().cast("array<string>")), F.coalesce(words(reference), F.array().cast("array<string>"))
    known = pairs.withColumns({"__p": p, "__r": r}).withColumn("__v", F.array_sort(F.array_union("__p", "__r")))

    def character(word: Column) -> Column:
        code = F.array_position(F.col("__v"), word).cast("int") + FIRST
        return F.decode(F.unhex(F.lpad(F.hex(F.when(code >= 0xD800, code + 0x800).otherwise(code)), 8, "0")), "UTF-32")

    coded = lambda c: F.array_join(F.transform(c, character), "")
    edits = F.levenshtein(coded(F.col("__p")), coded(F.col("__r")))
    n = F.size("__r")
    return known.withColumn(out, F.when(n == 0, F.when(F.size("__p") > 0, 1.0).otherwise(0.0)).otherwise(edits / n)).drop("__p", "__r", "__v")
