"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one for each shard.

Vectors are deduplicated first: a graph holds each vector once, with its least ids (as many as an answer may need), so a
vector that a third of all rows share is one node. Distinct vectors are dealt to shards by their hash. In a shard, points
enter in random batches: a greedy search from the entry point proposes neighbours, relaxed distance pruning keeps edges
only where no kept edge leads closer (by the factor ``alpha``), back edges are added and pruned alike. Inner products
become distances by one more coordinate that brings all vectors of a shard to the same length.

Queries run a beam search in every shard; the shards' best are merged, and scores are exact inner products of the original
vectors in double precision. A shard's graph travels once, to the task that searches it, and the queries stream past it
there in batches; each is a narrow row, and only its best of a shard leave the task.

Null and empty vectors, those that are all zero and those with a null or non-finite component take no part. Vectors of
another number of dimensions are no candidates. Repeated rows are candidates each; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinspark.llm.common import ship_package, written

DEGREE = 32
#: Places beyond the degree for edges back, so that a node is pruned once for many of them.
SLACK = 16
BUILD_BEAM = 64
SEARCH_BEAM = 192
ALPHA = 1.2
#: A table has at least this many shards, and more once a shard would hold more vectors than this.
SHARDS = 12
SHARD_ROWS = 32_768
#: Bytes of vectors that a shard holds, so that its graph fits one row.
SHARD_BYTES = 64 << 20
STEP = 256


def usable(embedding: Column) -> Column:
    """No null, no empty array, no null or non-finite component, not all zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0)


class Graph:
    """A directed graph over the rows of ``x``; ``edges`` holds each one's neighbours from the front, -1 where there is none."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.edges, self.entry = x, edges, entry

    @staticmethod
    def lifted(x: np.ndarray) -> np.ndarray:
        """With a coordinate that makes all lengths equal: then nearest is largest inner product."""
        norms = np.einsum("ij,ij->i", x, x)
        return np.column_stack([x, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        y = cls.lifted(x)
        entry = int(np.argmin(((y - y.mean(axis=0)) ** 2).sum(axis=1)))
        edges = np.full((n, degree + SLACK), -1, dtype=np.int32)  # front-packed
        if n > 1:
            k = min(degree // 2, n - 1)
            start = rng.integers(0, n - 1, (n, k)).astype(np.int32)
            edges[:, :k] = start + (start >= np.arange(n)[:, None])
        g = cls(y, edges, entry)
        for factor, width in ((1.0, beam // 2), (alpha, beam)):
            order = rng.permutation(n)
            for lo in range(0, n, STEP):
                rows = order[lo : lo + STEP]
                ids, _ = g.search(y[rows], width, width)
                pool = np.concatenate([ids, edges[rows]], axis=1)
                edges[rows] = g.prune(rows, pool, degree, factor)
                g.link_back(rows, degree, factor)
        return g

    def distances(self, rows: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Squared distances of rows to their candidates; infinite where there is none."""
        d = self.x[pool] - self.x[rows][:, None, :]
        out = np.einsum("ijk,ijk->ij", d, d)
        out[pool < 0] = np.inf
        return out

    def prune(self, rows: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Keep the nearest candidate, drop those that it leads closer to by ``alpha``, and so on."""
        pool = np.where(pool == rows[:, None], -1, pool)
        order = np.sort(pool, axis=1)
        twice = np.zeros_like(order, dtype=bool)
        twice[:, 1:] = order[:, 1:] == order[:, :-1]
        pool = np.where(twice, -1, order)
        d = self.distances(rows, pool)
        near = np.argsort(d, axis=1, kind="stable")
        pool, d = np.take_along_axis(pool, near, 1), np.take_along_axis(d, near, 1)
        v = self.x[pool]
        out = np.full((len(rows), self.edges.shape[1]), -1, dtype=np.int32)
        at = np.arange(len(rows))
        for k in range(degree):
            first = np.argmin(d, axis=1)
            ok = np.isfinite(d[at, first])
            if not ok.any():
                break
            out[ok, k] = pool[at, first][ok]
            gap = v - v[at, first][:, None, :]
            between = np.einsum("ijk,ijk->ij", gap, gap)
            gone = alpha * alpha * between <= d
            gone[at, first] = True
            d[gone & ok[:, None]] = np.inf
        return out

    def link_back(self, rows: np.ndarray, degree: int, alpha: float) -> None:
        """Edges back to ``rows``: into free places, and by pruning where there are none left."""
        src = np.repeat(rows, self.edges.shape[1])
        dst = self.edges[rows].reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        known = (self.edges[dst] == src[:, None]).any(axis=1)
        src, dst = src[~known], dst[~known]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        held = (self.edges[targets] >= 0).sum(axis=1)
        slot = np.arange(len(dst)) - np.repeat(first, count)
        room = held + count <= self.edges.shape[1]
        fits = np.repeat(room, count)
        self.edges[dst[fits], np.repeat(held, count)[fits] + slot[fits]] = src[fits]
        full = np.flatnonzero(~room)
        for lo in range(0, len(full), STEP):
            some = full[lo : lo + STEP]
            t, f, c = targets[some], first[some], count[some]
            more = np.full((len(t), c.max()), -1, dtype=np.int32)
            place = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            more[np.repeat(np.arange(len(t)), c), place] = src[np.repeat(f, c) + place]
            self.edges[t] = self.prune(t, np.concatenate([self.edges[t], more], axis=1), degree, alpha)

    def search(self, q: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for all rows of ``q`` (lifted) at once: the k nearest nodes met, and their distances."""
        m, n = len(q), len(self.x)
        beam = min(max(beam, k), n)
        ids = np.full((m, beam), -1, dtype=np.int32)
        d = np.full((m, beam), np.inf, dtype=np.float32)
        done = np.zeros((m, beam), dtype=bool)
        ids[:, 0] = self.entry
        d[:, 0] = ((q - self.x[self.entry]) ** 2).sum(axis=1)
        seen = np.zeros((m, n), dtype=bool)
        seen[:, self.entry] = True
        live = np.arange(m)
        while live.size:
            open_d = np.where(done[live], np.inf, d[live])
            best = np.argmin(open_d, axis=1)
            go = np.isfinite(open_d[np.arange(len(live)), best])
            live, best = live[go], best[go]
            if not live.size:
                break
            done[live, best] = True
            near = self.edges[ids[live, best]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            gap = self.x[near[r, c]] - q[live[r]]
            nd = np.full(near.shape, np.inf, dtype=np.float32)
            nd[r, c] = np.einsum("ij,ij->i", gap, gap)
            all_d = np.concatenate([d[live], nd], axis=1)
            all_i = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_v = np.concatenate([done[live], np.zeros_like(fresh)], axis=1)
            top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.arange(all_d.shape[1])[None, :].repeat(len(live), 0)
            d[live], ids[live], done[live] = (np.take_along_axis(z, top, 1) for z in (all_d, all_i, all_v))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)

    def lift_queries(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]).astype(np.float32)


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """embedding and its least ``keep`` ids. Each task keeps at most so many rows of a vector before the shuffle."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep)
    return ranked.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def build_index(spark: SparkSession, rows: DataFrame, keep: int, shards: int | None = None) -> tuple[DataFrame, int]:
    """Rows of a written index: shard, its graph and vectors, and the ids of each vector. All usable rows are indexed."""
    ship_package(spark)
    usable_rows = rows.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    distinct, _ = written(spark, distinct_vectors(usable_rows, keep), "vectors")
    n, most = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    count = shards or max(SHARDS, math.ceil(n / min(SHARD_ROWS, SHARD_BYTES // (8 * (most or 1)) or 1)))
    placed = distinct.select(F.pmod(F.xxhash64("embedding"), F.lit(count)).cast("int").alias("shard"), "embedding", "ids")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["embedding"].tolist(), dtype=np.float64)
        g = Graph.build(x)
        sizes = part["ids"].map(len).to_numpy()
        return pd.DataFrame(
            {
                "shard": [part["shard"].iat[0]], "n": [len(x)], "entry": [g.entry],
                "vectors": [x.tobytes()], "edges": [g.edges.tobytes()],
                "sizes": [sizes.astype(np.int64).tobytes()], "ids": [np.concatenate(part["ids"].tolist()).astype(np.int64).tobytes()],
            }
        )

    # One dimension for all: rows of another length are no candidates of each other, so they form graphs of their own.
    placed = placed.withColumn("dims", F.size("embedding"))
    built = placed.groupBy("shard", "dims").applyInPandas(lambda p: build(p[["shard", "embedding", "ids"]]).assign(dims=len(p["embedding"].iat[0])), "shard int, n long, entry long, vectors binary, edges binary, sizes binary, ids binary, dims int")
    index, _ = written(spark, built, "index")
    return index, count


class Shard:
    """A shard's graph with the ids of its vectors, as read from a row of the index."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dims"])
        self.graph = Graph(Graph.lifted(self.x), np.frombuffer(row["edges"], np.int32).reshape(row["n"], -1), row["entry"])
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def nearest(self, own: np.ndarray, y: np.ndarray, k: int, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and exact scores of the k nearest found for each query, its own row left out."""
        found, _ = self.graph.search(self.graph.lift_queries(y), beam, min(k + 1, len(self.x)))
        for i, v, nodes in zip(own.tolist(), y, found, strict=True):
            nodes = nodes[nodes >= 0]
            c = np.concatenate([self.ids[self.first[n] : self.first[n] + self.sizes[n]] for n in nodes])
            s = np.repeat(np.einsum("ij,j->i", self.x[nodes], v), self.sizes[nodes])
            c, s = c[c != i], s[c != i]
            top = np.lexsort((c, -s))[:k]
            yield c[top], s[top]


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest, its own row left out; ties to the smaller id."""
    asked = queries.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("query_id"), "embedding", F.size("embedding").alias("dims"))
    keys = index.select((F.col("shard") + 0).alias("shard"), (F.col("dims") + 0).alias("dims"))
    # The stated queries meet every shard: a row of ids and components for each, and one row for each graph.
    graph = [f.name for f in index.schema if f.name not in ("shard", "dims")]
    none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in graph]
    asked = asked.join(F.broadcast(keys), "dims").select("shard", "dims", F.lit(1).alias("part"), "query_id", "embedding", *none)
    held = index.select("shard", "dims", F.lit(0).alias("part"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast(queries.schema["embedding"].dataType).alias("embedding"), *graph)
    rows = held.unionByName(asked).repartition("shard", "dims").sortWithinPartitions("shard", "dims", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        at: tuple[int, int] | None = None
        for batch in batches:
            part = batch.column("part").to_numpy()
            place = list(zip(batch.column("shard").to_pylist(), batch.column("dims").to_pylist(), strict=True))
            lo = 0
            while lo < len(part):
                if part[lo] == 0:
                    shard, at = Shard({c: batch.column(c)[lo].as_py() for c in ("dims", *graph)}), place[lo]
                    lo += 1
                    continue
                hi = lo
                while hi < len(part) and part[hi] and place[hi] == place[lo] and hi - lo < STEP:
                    hi += 1
                if shard is not None and at == place[lo]:
                    own = batch.column("query_id")[lo:hi].to_numpy()
                    y = np.array(batch.column("embedding")[lo:hi].to_pylist(), dtype=np.float64)
                    top = list(shard.nearest(own, y, k, beam))
                    names = np.repeat(own, [len(c) for c, _ in top])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate([c for c, _ in top]), pa.int64()), pa.array(np.concatenate([s for _, s in top]), pa.float64())], names=["query_id", "vec_id", "score"])
                lo = hi

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, embeddings: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score for every query row (vec_id divisible by 20) against all rows.

    Without a usable vector there are no rows; with fewer candidates than ``k`` all of them. Other columns don't matter.
    """
    embeddings = embeddings.select("vec_id", "embedding")
    index, _ = build_index(spark, embeddings, k + 1)
    return search(spark, index, embeddings.where(F.col("vec_id") % 20 == 0), k)
