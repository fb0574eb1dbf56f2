"""Joins by edit distances with learned costs: a table of costs for pairs of characters, as a DataFrame of any origin.

A cost table has rows of two characters and what it costs to take one for the other (case ignored, either order). Equal
characters are free; pairs that the table doesn't hold, insertions and deletions cost 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinspark.functions.distance import GROUP_COST
from clinspark.functions.scalar import CONFUSABLE_FROM, CONFUSABLE_TO
from clinspark.operators import fuzzy

#: What a confusion costs that was seen very often, how fast costs fall, and from how many corrections on they do, and fully.
FLOOR, SCALE, LEAST_SEEN, FULL = 0.05, 10, 10, 100
#: Pairs that a cost table may hold: it travels with the tasks.
MOST_PAIRS = 1_000_000
#: Cells of bands that are worked on at a time.
STEP_CELLS = 1 << 21


def _ordered(table: DataFrame, a: str, b: str, value: str, how) -> DataFrame:
    """One row for each pair of different characters in sorted order, lower-cased."""
    x, y = F.lower(F.col(a)), F.lower(F.col(b))
    fine = (F.length(x) == 1) & (F.length(y) == 1) & (x != y) & F.col(value).isNotNull()
    return table.where(fine).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(how(value).alias(value))


def learned_costs(confusions: DataFrame, corrections: int, base: DataFrame | None = None) -> DataFrame:
    """a, b and cost from confusions (a, b, n) that were confirmed, and a table of what they cost before (a, b, cost).

    A pair's cost falls with its count towards ``FLOOR`` and is mixed with its cost before; the mixture grows with the number of
    ``corrections`` that all were learned from, up to ``FULL``. Below ``LEAST_SEEN`` nothing has been learned. Of a pair that
    the base holds twice the lesser cost counts.
    """
    seen = _ordered(confusions, "a", "b", "n", F.sum)
    if base is None:
        known = seen.select("a", "b", "n", F.lit(1.0).alias("before"))
    else:
        known = seen.join(_ordered(base, "a", "b", "cost", F.min), ["a", "b"], "full").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("cost").cast("double"), F.lit(1.0)).alias("before"))
    trust = min(corrections / FULL, 1.0) if corrections >= LEAST_SEEN else 0.0
    learned = F.col("before") * F.exp(-F.col("n") / SCALE) + FLOOR
    return known.select("a", "b", F.when(F.col("n") > 0, F.col("before") * (1 - trust) + learned * trust).otherwise(F.col("before")).alias("cost"))


def confusable_costs(cost: float = GROUP_COST) -> list[tuple[str, str, float]]:
    """Pairs of the characters that recognisers take for each other, all at one cost."""
    groups: dict[str, set[str]] = {}
    for x, y in zip(CONFUSABLE_FROM.lower(), CONFUSABLE_TO, strict=True):
        groups.setdefault(y, {y}).add(x)
    return [(x, y, cost) for g in groups.values() for x in sorted(g) for y in sorted(g) if x < y]


class Costs:
    """A cost table as sorted arrays, for tasks; and classes of characters that are linked by pairs cheaper than 1."""

    def __init__(self, pairs: list[tuple[str, str, float]]):
        keys = np.array([(ord(min(a, b)) << 21) | ord(max(a, b)) for a, b, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array([c for *_, c in pairs], dtype=float)[order]
        self.least = min([1.0, *(c for *_, c in pairs)])
        parent: dict[str, str] = {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b, c in pairs:
            if c < 1:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
        self.classes = {x: root(x) for x in parent}

    @classmethod
    def of(cls, table: DataFrame) -> Costs:
        rows = _ordered(table, "a", "b", "cost", F.min).limit(MOST_PAIRS + 1).collect()
        if len(rows) > MOST_PAIRS:
            raise ValueError(f"more than {MOST_PAIRS} pairs of characters")
        return cls([tuple(r) for r in rows])

    def fold(self, text: Column) -> Column:
        """A form whose plain edit distance to another such form is never more than the weighted one."""
        moved = sorted((x, y) for x, y in self.classes.items() if x != y)
        return F.translate(F.lower(text), "".join(x for x, _ in moved), "".join(y for _, y in moved)) if moved else F.lower(text)

    def cost(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """What it costs to take code points ``x`` for ``y``."""
        key = (np.minimum(x, y) << 21) | np.maximum(x, y)
        out = np.where(x == y, 0.0, 1.0)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where((x != y) & (self.keys[at] == key), self.values[at], out)
        return out

    def distances(self, a: list[str], b: list[str], limit: float) -> np.ndarray:
        """Distances of pairs of lower-case texts; not a number beyond the limit. Only the band that it allows is worked on."""
        k = int(limit)
        out = np.full(len(a), np.nan)
        n, m = (np.array([len(t) for t in s], dtype=np.int64) for s in (a, b))
        order = np.flatnonzero(np.abs(n - m) <= k)
        order = order[np.argsort(n[order], kind="stable")]
        lo = 0
        while lo < len(order):
            hi = lo + 1
            while hi < len(order) and (hi + 1 - lo) * (2 * k + 1) * (n[order[hi]] + 1) <= STEP_CELLS:
                hi += 1
            rows = order[lo:hi]
            out[rows] = self._band([a[i] for i in rows], [b[i] for i in rows], n[rows], m[rows], k)
            lo = hi
        out[out > limit] = np.nan
        return out

    def _band(self, a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
        """Row by row of all pairs' tables at once; column d of the band is the cell d - k from the diagonal."""
        x, y = _points(a), _points(b)
        off = np.arange(-k, k + 1)
        band = np.where(off >= 0, off, np.inf) * np.ones((len(a), 1))
        out = np.full(len(a), np.inf)
        rows = np.arange(len(a))
        done = n == 0
        out[done] = m[done]
        live = rows[~done]
        band = band[live]
        for i in range(1, x.shape[1] + 1):
            j = i + off
            inside = (j >= 1) & (j <= y.shape[1])
            swap = np.full((len(live), len(off)), np.inf)
            swap[:, inside] = band[:, inside] + self.cost(x[live, i - 1][:, None], y[live][:, j[inside] - 1])
            drop = np.concatenate([band[:, 1:] + 1, np.full((len(live), 1), np.inf)], axis=1)
            new = np.minimum(swap, drop)
            new[:, j == 0] = i
            new[:, j < 0] = np.inf
            for d in range(1, len(off)):
                if j[d] >= 1:
                    new[:, d] = np.minimum(new[:, d], new[:, d - 1] + 1)
            band = new
            ends = np.flatnonzero(n[live] == i)
            out[live[ends]] = band[ends, m[live[ends]] - i + k]
            go = (n[live] > i) & (band.min(axis=1) <= k + 1)
            if not go.all():
                live, band = live[go], band[go]
            if not len(live):
                break
        return out


def _points(texts: list[str]) -> np.ndarray:
    """Code points, a row for each text, filled up with -1."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out


def weighted_distance(a: Column, b: Column, costs: Costs, limit: float) -> Column:
    """The distance of two texts, case ignored, up to the limit; null beyond, and if either is null."""

    @F.arrow_udf("double")
    def measure(x: pa.Array, y: pa.Array) -> pa.Array:
        left, right = x.to_pylist(), y.to_pylist()
        there = [i for i, (p, q) in enumerate(zip(left, right, strict=True)) if p is not None and q is not None]
        out = np.full(len(left), np.nan)
        out[there] = costs.distances([left[i] for i in there], [right[i] for i in there], limit)
        return pa.array(out, pa.float64(), from_pandas=True)

    return measure(F.lower(a), F.lower(b))


def nearest(tokens: DataFrame, token: str, lexicon: DataFrame, term: str, costs: DataFrame, limit: float) -> DataFrame:
    """token, term and distance of the nearest term of each different token by the table's costs, within ``limit``; ties to the lesser term.

    Pairs are proposed by segments of forms in which characters of a class (those linked by pairs cheaper than 1) are one:
    no pair within the limit is lost, whatever the table holds. Nulls take no part; costs must not be negative.
    """
    known = Costs.of(costs)
    return fuzzy.nearest_by_weight(tokens, token, lexicon, term, known.fold, lambda a, b: weighted_distance(a, b, known, limit), limit, known.least)
