"""Near-duplicate removal by wide SimHash: five-word shingles, a similarity of 0.8 or more, one document of each group.

The similarity is the cosine of the two sets of different shingles, which is what SimHash estimates: the shared ones over
the root of the product of the sizes. For texts of one length 0.8 is a Jaccard similarity of 2/3.

1. Each different set of shingles is a node, with a SimHash of 512 bits over its different shingles (64 bits can't tell a
   similarity of 0.8 from 0.7), and with shards named by min-hash triples: sets of a similarity of 0.8 share one of
   twenty with a probability of at least 0.997.
2. In a shard, a BK-tree over the fingerprints gives a spanning forest of the pairs within ``RADIUS``, the distance that
   belongs to a similarity of 0.8 and 3.5 standard deviations more. These are candidates only; their components are loose
   classes.
3. The members of a loose class travel once more, with the hashes of their shingles. A BK-tree proposes pairs, nearest
   first, and the exact similarity of the two sets decides. Pairs that are linked by others already need no look, so a
   class of n copies takes about n comparisons.

A class beyond ``max_block`` members is held against one member first; those that are its copies need no more looks at
each other, only the rest is dealt into groups, each pair of which is a task's work. So a huge group of copies costs in
proportion to its size, and every link within the rest and between both is still looked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.llm.common import few_files, ship_package, written
from clinspark.llm.components import connected_components
from clinspark.llm.simhash import BKTree, forest, shingle_hashes

WORDS = 8
KEYS, PER_KEY = 20, 3
STEP = 8_160
SIMILARITY = 0.8
#: Bytes of pivots that a broadcast may hold; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
_U = np.uint64


def _constants(n: int, seed: int) -> list[np.uint64]:
    """Odd 64-bit constants from a simple generator."""
    x, out = seed, []
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(_U((x ^ (x >> 29)) | 1))
    return out


_SPREAD = _constants(WORDS, 11)
_MINS = _constants(KEYS * PER_KEY, 23)
_JOIN = _constants(PER_KEY, 37)


def radius_of(similarity: float, deviations: float = 3.5, bits: int = 64 * WORDS) -> int:
    """The expected Hamming distance of two sets of this cosine similarity, and so many standard deviations more."""
    p = math.acos(similarity) / math.pi
    return round(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


RADIUS = radius_of(SIMILARITY)


def sketch(hashes: list[int]) -> tuple[int, bytes, list[int], bytes]:
    """Of a text's shingle hashes: the node, the wide fingerprint, the shards, and the different hashes' lower halves."""
    from xxhash import xxh64_intdigest

    h = np.unique(np.array(hashes, dtype="<u8"))
    node = int(np.uint64(xxh64_intdigest(h.tobytes())).view(np.int64))
    if not len(h):
        return node, bytes(8 * WORDS), [0], b""
    counts = np.zeros(64 * WORDS, dtype=np.int64)
    mins = np.full(len(_MINS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(h), STEP):
        x = h[lo : lo + STEP]
        wide = np.empty((len(x), WORDS), dtype="<u8")
        for j, c in enumerate(_SPREAD):
            z = x * c
            z = (z ^ (z >> _U(32))) * c
            wide[:, j] = z ^ (z >> _U(29))
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # sums of 255 rows fit a byte
            counts += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
        for j, c in enumerate(_MINS):
            mins[j] = min(mins[j], (x * c).min())
    fingerprint = np.packbits(2 * counts > len(h), bitorder="little").tobytes()
    keys = np.zeros(KEYS, dtype=np.uint64)
    for k in range(PER_KEY):
        keys = (keys ^ mins[k::PER_KEY]) * _JOIN[k]
        keys ^= keys >> _U(31)
    keys += np.arange(KEYS, dtype=np.uint64)
    return node, fingerprint, keys.view(np.int64).tolist(), np.unique(h.astype("<u4")).tobytes()


def sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, text_hash, node, fingerprint, shards and shingles of every row with a key, which keeps its type."""
    ship_package(docs.sparkSession)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    made = T._parse_datatype_string("node long, fingerprint binary, shards array<long>, shingles binary")
    schema = T.StructType([*rows.schema.fields[:2], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                with np.errstate(over="ignore"):
                    made = [sketch(shingle_hashes(t, width) if t else []) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of sorted rows that agree in the first ``keys`` columns, if of more than one row; an empty list ends a batch."""
    block: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block and row[:keys] != block[0][:keys]:
                if len(block) > 1:
                    yield block
                block = []
            block.append(row)
        yield []
    if len(block) > 1:
        yield block


def _pairs(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for pairs in found:
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["src", "dst"])


def candidates(members: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """src, dst: a spanning forest of each shard's pairs within the radius. members: shard, node, fingerprint, each node once in a shard."""
    # Written first, so that both sides of the join are plain tables and a hot shard is split at run time.
    sizes, _ = written(members.sparkSession, few_files(members.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")), "shard-sizes")
    sized = members.join(sizes, "shard")
    groups = F.ceil(F.col("size") / max_shard).cast("int")
    own = F.pmod(F.xxhash64("node"), groups).cast("int")
    dealt = sized.withColumn("groups", groups).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    keys = ["shard", "a", "b"]
    rows = dealt.select("shard", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"), "node", "fingerprint")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)

    def found(block: list[tuple]) -> list[tuple[int, int]]:
        nodes: dict[int, list[int]] = {}
        for *_, n, f in block:
            nodes.setdefault(int.from_bytes(f, "little"), []).append(n)
        alike = [(same[0], n) for same in nodes.values() for n in same[1:]]
        left = list(dict.fromkeys(int.from_bytes(r[5], "little") for r in block if not r[3]))
        right = None if block[0][1] == block[0][2] else list(dict.fromkeys(int.from_bytes(r[5], "little") for r in block if r[3]))
        return alike + [(nodes[a][0], nodes[b][0]) for a, b in forest(left, right, radius)]

    return rows.mapInArrow(lambda batches: _pairs(found(b) for b in _blocks(batches, 3) if b), "src long, dst long")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this cosine similarity; empty ones are alike."""
    least = similarity * math.sqrt(len(a) * len(b))
    return min(len(a), len(b)) >= least and len(np.intersect1d(a, b, assume_unique=True)) >= least


def exact_links(block: list[tuple], radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the exact links of a block: within it, or between its two groups. Rows end with second, node, fingerprint, shingles."""
    across = block[0][1] != block[0][2]
    value = [int.from_bytes(r[-2], "little") for r in block]
    sets = [np.frombuffer(r[-1], "<u4") for r in block]
    parent = list(range(len(block)))
    tree, held, out = BKTree(), {}, []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def hold(i: int) -> None:
        held.setdefault(tree.add(value[i]), []).append(i)

    if across:
        for i, r in enumerate(block):
            if not r[-4]:
                hold(i)
    for i, r in enumerate(block):
        if across and not r[-4]:
            continue
        near = sorted(((tree.values[k] ^ value[i]).bit_count(), j) for k in tree.within(value[i], radius) for j in held[k])
        for _, j in near:
            if (a := root(i)) != (b := root(j)) and similar(sets[i], sets[j], similarity):
                parent[a] = b
                out.append((r[-3], block[j][-3]))
        if not across:
            hold(i)
    return out


def links(spark: SparkSession, members: DataFrame, radius: int, similarity: float, max_block: int) -> DataFrame:
    """src, dst: links of at least this exact similarity that connect all that are linked within a class. members: component, least, node, fingerprint, shingles."""
    sizes, _ = written(spark, few_files(members.groupBy("component").agg(F.count("*").alias("size"))), "class-sizes")
    columns = ["component", "node", "fingerprint", "shingles"]
    keys = ["component", "a", "b"]
    small = members.join(sizes.where(F.col("size") <= max_block), "component")
    rows = small.select("component", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("second"), *columns[1:])
    found = []
    large = sizes.where(F.col("size") > max_block)
    if large.limit(1).count():
        inside = members.join(large.select("component"), "component")
        pivots, _ = written(spark, few_files(inside.groupBy("component").agg(F.min_by(F.struct("node", "shingles"), F.struct("least", "node")).alias("pivot"))), "pivots")
        weight = pivots.agg(F.sum(F.length("pivot.shingles") + 64)).first()[0]
        held = F.broadcast(pivots) if weight <= BROADCAST_BYTES else pivots

        def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, other = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                yes = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity) for x, y in zip(own, other, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(5), pa.array(yes, pa.bool_())], names=[*columns, "pivot", "linked"])

        judged = inside.join(held, "component").select(*columns, F.col("pivot.shingles").alias("other"), F.col("pivot.node").alias("pivot")).mapInArrow(against, "component long, node long, fingerprint binary, shingles binary, pivot long, linked boolean")
        judged, _ = written(spark, few_files(judged), "pivot-links")
        found.append(judged.where("linked AND node <> pivot").select(F.col("pivot").alias("src"), F.col("node").alias("dst")))
        groups = judged.groupBy("component").agg(F.ceil(F.sum((~F.col("linked")).cast("long")) / max_block).cast("int").alias("rest"), F.ceil(F.sum(F.col("linked").cast("long")) / max_block).cast("int").alias("copies"))
        own = F.when(F.col("linked"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("copies"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
        last = F.when(F.col("linked"), F.col("rest")).otherwise(F.col("rest") + F.col("copies")) - 1
        dealt = judged.join(groups.where("rest > 0"), "component").select(*columns, own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        rows = rows.unionByName(dealt.select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"), *columns[1:]))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    found.append(rows.mapInArrow(lambda batches: _pairs(exact_links(b, radius, similarity) for b in _blocks(batches, 3) if b), "src long, dst long"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def classes(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = SIMILARITY, radius: int = RADIUS, max_shard: int = 500, max_block: int = 1000) -> DataFrame:
    """key, text_hash, class_id (the least key of its group) and kept (whether the row is the one that stays) of every row with a key.

    Of rows that repeat a key the one with the least text hash is the first; rows that repeat both are marked alike.
    """
    marked, _ = written(spark, sketches(docs, key, text, width), "sketches")
    row = F.struct("key", "text_hash")
    distinct, _ = written(spark, few_files(marked.groupBy("node").agg(F.min(row).alias("least"), F.min_by("fingerprint", row).alias("fingerprint"), F.min_by("shards", row).alias("shards"))), "distinct-sketches")
    pairs, _ = written(spark, few_files(candidates(distinct.select(F.explode("shards").alias("shard"), "node", "fingerprint"), radius, max_shard)), "candidates")
    loose, _ = written(spark, few_files(connected_components(spark, pairs)), "loose-classes")
    named = loose.join(distinct.select("node", "least", "fingerprint"), "node")
    first = marked.select("node", row.alias("least"), "shingles").dropDuplicates(["node", "least"]) if _repeats(marked) else marked.select("node", row.alias("least"), "shingles")
    members = named.join(first, ["node", "least"]).select("component", "least", "node", "fingerprint", "shingles")
    edges, _ = written(spark, few_files(links(spark, members, radius, similarity, max_block)), "near-links")
    labels = connected_components(spark, edges)
    named = distinct.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = named.join(named.groupBy("component").agg(F.min("least").alias("first")), "component").select("node", "first")
    return marked.select("node", "key", "text_hash").join(least, "node").select(F.col("key").alias(key), "text_hash", F.col("first.key").alias("class_id"), (F.struct("key", "text_hash") == F.col("first")).alias("kept"))


def _repeats(marked: DataFrame) -> bool:
    """Whether some row occurs twice."""
    return bool(marked.groupBy("key", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def deduplicate(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group, that of the least key; other columns stay as they are.

    Rows with a null key stay. Texts without words, null ones included, are copies of each other. Rows go by key and text,
    so a key that repeats with another text loses only the copies among its texts; of rows that repeat both, one stays.
    Texts of any length are taken whole. An empty table stays one. Keys may be of any type that has an order.
    """
    judged, _ = written(spark, few_files(classes(spark, docs, key, text, **options)), "near-classes")
    gone = judged.where(~F.col("kept")).select(F.col(key).alias("__gone"), F.col("text_hash").alias("__gone_text"))
    same = (docs[key] == gone["__gone"]) & (F.xxhash64(docs[text]) == gone["__gone_text"])
    rest = docs.join(gone, same, "left_anti")
    twice = judged.where("kept").groupBy(key, "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.limit(1).count():
        return rest
    once = rest.where(F.col(key).isNotNull()).withColumn("__text_hash", F.xxhash64(F.col(text))).dropDuplicates([key, "__text_hash"]).drop("__text_hash")
    return once.unionByName(rest.where(F.col(key).isNull()))
