"""SimHash near-duplicates: fingerprints, links within a Hamming radius from BK-trees, and components.

Links are searched among *different* fingerprints only, so exact copies cost nothing, however many there are. Two
fingerprints that differ in at most r of 64 bits agree wholly in some of the blocks that the bits are cut into; each
choice of agreeing blocks, with their bits, names a shard, and every linked pair meets in one. A shard's BK-tree keeps
its members by their Hamming distance to the parent, and a search follows the edges within the radius alone.

A shard gives a spanning forest of its links, never all pairs. A shard beyond ``max_shard`` members is dealt into
groups: the tree of one group is searched with the members of another, each pair of groups in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.llm.common import ship_package, without, written
from clinspark.llm.components import connected_components

#: The white space that ends a word.
WHITE = " \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TO_SPACE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: Hashes whose bits are counted at a time.
STEP = 1 << 16


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included; of all words, if fewer; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    n = len(words)
    if n <= width:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - width] + 1).tolist()]
    return [xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[str | None], width: int = 4) -> np.ndarray:
    """A bit is set if it is set in over half of a text's shingle hashes; zero for a text without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for row, text in enumerate(texts):
        hashes = shingle_hashes(text, width) if text else []
        if not hashes:
            continue
        h = np.array(hashes, dtype="<u8")
        counts = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(h), STEP):
            bits = np.unpackbits(h[lo : lo + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int32)
        out[row] = weights[2 * counts > len(h)].sum(dtype=np.uint64)
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", width: int = 4) -> DataFrame:
    """``docs`` with the SimHash of each whole text as a long (null and blank texts: 0). Replaces a column of that name."""
    ship_package(docs.sparkSession)
    kept = without(docs, out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                f = fingerprints(part.column(part.schema.get_field_index(text)).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(f.view(np.int64))], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert; the number of the node (of the one there is, for a value that is in already)."""
        if not self.values:
            return self._node(value)
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            on = self.children[at].get(d)
            if on is None:
                self.children[at][d] = new = self._node(value)
                return new
            at = on

    def _node(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes at most ``radius`` away; an edge is followed only if the triangle inequality allows."""
        if not self.values:
            return
        stack, values, children = [0], self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            down = children[at]
            if down:
                if len(down) <= 2 * radius + 1:
                    stack += [k for e, k in down.items() if d - radius <= e <= d + radius]
                else:
                    stack += [down[e] for e in range(d - radius, d + radius + 1) if e in down]


def forest(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left``, or of those between ``left`` and ``right``."""
    tree, parent = BKTree(), list(range(len(left)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out: list[tuple[int, int]] = []
    if right is None:
        for v in left:
            near = list(tree.within(v, radius))
            n = tree.add(v)
            for k in near:
                a, b = root(k), root(n)
                if a != b:
                    parent[b] = a
                    out.append((tree.values[k], v))
        return out
    for v in left:
        tree.add(v)
    for v in right:
        first = None
        for k in tree.within(v, radius):
            if first is None:
                first = k
                out.append((tree.values[k], v))
            elif (a := root(first)) != (b := root(k)):
                parent[b] = a
                out.append((tree.values[k], v))
    return out


def plan_blocks(n: int, radius: int) -> tuple[int, int]:
    """(blocks, agreeing blocks) for n fingerprints: keys of about log2(n) bits, so shards stay small as n grows.

    Every choice is exact: of b blocks at most ``radius`` hold a differing bit, so b - radius agree.
    """
    for extra in range(1, 5):
        blocks = radius + extra
        if 64 * extra // blocks >= np.log2(max(n, 2)) - 7 or extra == 4:
            return blocks, extra
    raise AssertionError


def shard_keys(column: str, blocks: int, agree: int) -> F.Column:
    """An array of the fingerprint's shards: the choice of blocks, and the bits in them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("choice"), F.col(column).bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def links(spark: SparkSession, distinct: DataFrame, radius: int, max_shard: int = 2000) -> DataFrame:
    """src, dst: a spanning forest, shard by shard, of the links between the distinct longs of column ``fingerprint``."""
    ship_package(spark)
    n = distinct.count()
    blocks, agree = plan_blocks(n, radius)
    members = distinct.select("fingerprint", F.explode(shard_keys("fingerprint", blocks, agree)).alias("shard"))
    # Shards of one member have no links; the others learn their size. Written first, so that a hot shard is split at run time.
    sizes, _ = written(spark, members.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1"), "shard-sizes")
    members = members.join(sizes, "shard").select("fingerprint", "shard.choice", "shard.bits", "size")
    groups = F.ceil(F.col("size") / max_shard).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), groups).cast("int")
    dealt = members.withColumn("groups", groups).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    dealt = dealt.select("choice", "bits", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"), "fingerprint")

    keys = ["choice", "bits", "a", "b"]
    rows = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "second", "fingerprint")
    return rows.mapInArrow(lambda batches: _walk(batches, radius), "src long, dst long")


def _walk(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Forests of the shards that follow each other in the sorted rows of a task."""
    rest: list[np.ndarray] | None = None

    def found(columns: list[np.ndarray], bounds: list[int]) -> list[tuple[int, int]]:
        a, b, second, f = columns[2], columns[3], columns[4], columns[5].view(np.uint64).tolist()
        out: list[tuple[int, int]] = []
        for i, j in zip(bounds, bounds[1:], strict=False):
            if j - i == 2:
                if (f[i] ^ f[i + 1]).bit_count() <= radius and (a[i] == b[i] or second[i] != second[i + 1]):
                    out.append((f[i], f[i + 1]))
            elif j - i > 2:
                if a[i] == b[i]:
                    out += forest(f[i:j], None, radius)
                else:
                    mask = second[i:j]
                    part = columns[5][i:j].view(np.uint64)
                    out += forest(part[~mask].tolist(), part[mask].tolist(), radius)
        return out

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["src", "dst"])

    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        cuts = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns[:4]], axis=0)) + 1).tolist()
        yield batch_of(found(columns, [0, *cuts]))
        rest = [x[cuts[-1] if cuts else 0 :] for x in columns]
    if rest is not None:
        yield batch_of(found(rest, [0, len(rest[0])]))


def classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """key, fingerprint (long) and component_id, the least key reachable over links, of every row of ``docs``.

    Rows with a null key count in their class, but can't name it unless all its keys are null (then null). Repeated
    rows are kept, each with its class. Keys may be of any type that has an order; other columns are not read. Null texts
    and texts without words have fingerprint zero; texts of any length are taken whole. An empty table stays one.
    """
    marked, _ = written(spark, with_fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", width=width).select("key", "fingerprint"), "fingerprints")
    distinct, _ = written(spark, marked.groupBy("fingerprint").agg(F.min("key").alias("least")), "distinct-fingerprints")
    edges, _ = written(spark, links(spark, distinct.select("fingerprint"), radius), "links")
    # Nodes are fingerprints: those without a link are components of their own and take no part in the search.
    labels = connected_components(spark, edges)
    named = distinct.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    least = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fingerprint", "component_id")
    return marked.join(least, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every document."""
    return classes(spark, docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
