"""Embedding near-duplicates by product quantisation: inverted lists, residual subspace codes, exact cosine at the end.

1. Equal vectors are one node, with the number of its rows and its least id.
2. A coarse quantiser (k-means on a bounded sample) deals the unit vectors to inverted lists. What is left of a vector after
   its list's centroid is cut into subspaces of ``SUB`` components, each coded by one of 256 words. A code keeps its error.
3. A vector probes its own list and every list that sufficient probes ask for: vectors of a cosine of at least c lie within
   r = sqrt(2 - 2c); if x has centroid a and y has b, the gaps |x-b|^2-|x-a|^2 and |y-a|^2-|y-b|^2 sum up to at most
   2 r |a-b|, so one of the two is at most r |a-b|. Whoever's gap is that small probes the other's list, and no pair is lost.
4. In a list, a query's table of distances to all code words gives its distance to each member's code by look-ups. By the
   triangle inequality a member within r has a code within r plus its error: the rest is left out, the others have their
   exact cosine taken from the original vectors in double precision.

A list beyond ``PART`` members is dealt into parts, its queries into blocks; each pair of both is a task's work. A task gives
the numbers of links and a spanning forest of them, never the pairs of a dense group. A pair that both sides probe counts
where the lesser list probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspark.llm.ann import usable
from clinspark.llm.common import ship_package, without, written
from clinspark.llm.components import connected_components

COSINE = 0.95
#: Vectors of a list on average, as long as there are no more lists than ``MAX_LISTS``.
LIST_ROWS = 256
MAX_LISTS = 4096
#: The sample that quantisers are fitted on: vectors a list, at least, and bytes at most.
PER_LIST, LEAST_SAMPLE, SAMPLE_BYTES = 16, 8192, 64 << 20
#: Quantisers are fitted for so many numbers of dimensions, the most frequent; vectors of others are compared without codes.
MAX_KINDS = 8
SUB, WORDS = 4, 256
PART, BLOCK = 16_384, 8_192
STEP = 256
#: Bytes of a table of distances to all centroids that k-means fills at a time.
STEP_BYTES = 8 << 20
#: Rows of list sizes that a broadcast may hold; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
SLACK = 1e-3


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever the size of their components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the squared distances to all, less the row's own square."""
    d = np.einsum("ij,ij->i", centroids, centroids) - 2 * (x @ centroids.T)
    return np.argmin(d, axis=1), d


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the rows of ``x``; a centroid that has lost its rows starts again at a row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    step = max(1, min(4096, STEP_BYTES // (8 * max(1, k))))
    for _ in range(rounds):
        home = np.concatenate([nearest(x[lo : lo + step], c)[0] for lo in range(0, len(x), step)])
        n = np.bincount(home, minlength=k)
        c = np.column_stack([np.bincount(home, weights=col, minlength=k) for col in x.T]) / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


class Quantiser:
    """Centroids of the lists, and a book of code words for each subspace of what is left."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 5):
        self.dims = x.shape[1]
        self.centroids = kmeans(x, lists, seed)
        rest = self.rest(x, nearest(x, self.centroids)[0])
        self.books = [kmeans(rest[:, m], WORDS, seed + m) for m in range(rest.shape[1])]

    def rest(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Residuals as (row, subspace, component); the last subspace is filled up with zeros."""
        out = np.zeros((len(x), -(-self.dims // SUB) * SUB))
        out[:, : self.dims] = x - self.centroids[home]
        return out.reshape(len(x), -1, SUB)

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each subspace of each row, and the distance from the row to its code."""
        rest = self.rest(x, home)
        out = np.empty(rest.shape[:2], dtype=np.uint8)
        left = np.zeros(len(x))
        for m, book in enumerate(self.books):
            out[:, m] = nearest(rest[:, m], book)[0]
            left += ((rest[:, m] - book[out[:, m]]) ** 2).sum(axis=1)
        return out, np.sqrt(left)

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The list of each row, and which lists it probes (row by list)."""
        home, d = nearest(x, self.centroids)
        own = self.centroids[home]
        square = np.einsum("ij,ij->i", self.centroids, self.centroids)
        apart = np.sqrt(np.maximum(square[home][:, None] + square - 2 * (own @ self.centroids.T), 0))
        asked = d - d[np.arange(len(x)), home][:, None] <= reach * apart + 1e-9
        asked[np.arange(len(x)), home] = True
        return home, asked

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of the coded members of list ``at`` (rows) to the rows of ``x`` (columns), from tables.

        A table has a row for each code word, so that a look-up for all queries is one copy of a row.
        """
        rest = self.rest(x, np.full(len(x), at)).astype(np.float32)
        out = np.zeros((len(codes), len(x)), dtype=np.float32)
        for m, book in enumerate(self.books):
            own, book = rest[:, m], book.astype(np.float32)
            table = np.einsum("ij,ij->i", book, book)[:, None] - 2 * (book @ own.T) + np.einsum("ij,ij->i", own, own)
            out += table[codes[:, m]]
        return out


class Models:
    """Quantisers by the number of dimensions; the lists of all are numbered through."""

    def __init__(self, quantisers: list[Quantiser]):
        self.quantisers, self.first, n = quantisers, [], 0
        for q in quantisers:
            self.first.append(n)
            n += len(q.centroids)
        self.lists = n

    def of(self, dims: int) -> tuple[Quantiser, int] | None:
        return next(((q, f) for q, f in zip(self.quantisers, self.first, strict=True) if q.dims == dims), None)

    def of_list(self, at: int) -> tuple[Quantiser, int]:
        return next((q, f) for q, f in zip(self.quantisers, self.first, strict=True) if f <= at < f + len(q.centroids))


def fit(vectors: DataFrame) -> Models:
    """Quantisers from a sample of the different vectors, in the order of their hash. The sample's size is PER_LIST
    vectors for each of at most MAX_LISTS lists, and SAMPLE_BYTES (see :func:`sampled`)."""
    kinds = vectors.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(MAX_KINDS).collect()
    quantisers = []
    for dims, n in kinds:
        lists = min(MAX_LISTS, math.ceil(n / LIST_ROWS), max(1, (SAMPLE_BYTES // 16) // (8 * dims)))
        most = max(1, min(max(PER_LIST * lists, LEAST_SAMPLE), SAMPLE_BYTES // (8 * dims)))
        quantisers.append(Quantiser(sampled(vectors, dims, n, most), lists))
    return Models(quantisers)


#: Places that a hash may take in the choice of a sample.
PLACES = 1 << 30


def sampled(vectors: DataFrame, dims: int, n: int, most: int) -> np.ndarray:
    """About ``most`` of the ``n`` vectors of ``dims`` components, as unit vectors in the order of their hash.

    Their hash alone chooses them, so that nothing but the sample reaches the driver: an ORDER BY with a LIMIT would bring it
    as many rows of every partition. They travel as bytes.
    """
    place = F.xxhash64("embedding")
    own = vectors.where(F.size("embedding") == dims).select(place.alias("place"), "embedding")
    if most < n:
        own = own.where(F.pmod("place", F.lit(PLACES)) < max(1, PLACES * most // n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in units(values)], pa.binary())], names=["place", "vector"])

    found = own.mapInArrow(run, "place long, vector binary").toArrow()
    if not found.num_rows:  # few vectors, none of them below the bound
        found = vectors.where(F.size("embedding") == dims).select(place.alias("place"), "embedding").limit(1).mapInArrow(run, "place long, vector binary").toArrow()
    order = np.argsort(found.column("place").to_numpy(), kind="stable")
    return _matrix(found.column("vector"), np.float64)[order]


CODED = "node long, copies long, list int, asked array<int>, vector binary, code binary, error double, bits binary"


def encode(vectors: DataFrame, models: Models, reach: float) -> DataFrame:
    """node, copies, its list, the lists it probes (and as bits), the unit vector, its code and the code's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                part = batch.slice(lo, STEP)
                values = part.column("embedding")
                sizes = np.asarray(values.value_lengths())
                node, copies = part.column("node").to_numpy(), part.column("copies").to_numpy()
                for dims in np.unique(sizes).tolist():
                    rows = np.flatnonzero(sizes == dims)
                    x = units(np.array(values.take(pa.array(rows)).to_pylist(), dtype=np.float64))
                    own = models.of(dims)
                    if own is None:
                        home, asked, code, error, bits = [-dims] * len(rows), [[-dims]] * len(rows), [None] * len(rows), [None] * len(rows), [None] * len(rows)
                    else:
                        q, first = own
                        at, probed = q.probes(x, reach)
                        c, e = q.codes(x, at)
                        flags = np.zeros((len(rows), models.lists), dtype=bool)
                        flags[:, first : first + probed.shape[1]] = probed
                        home, asked = (at + first).tolist(), [np.flatnonzero(f).tolist() for f in flags]
                        code, error, bits = [v.tobytes() for v in c], e.tolist(), [v.tobytes() for v in np.packbits(flags, axis=1, bitorder="little")]
                    columns = [pa.array(node[rows]), pa.array(copies[rows]), pa.array(home, pa.int32()), pa.array(asked, pa.list_(pa.int32())), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(code, pa.binary()), pa.array(error, pa.float64()), pa.array(bits, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "copies", "list", "asked", "vector", "code", "error", "bits"])

    return vectors.select("node", "copies", "embedding").mapInArrow(run, CODED)


class Members:
    """A part of a list: its vectors and codes, how many rows they are linked to so far, and what hangs together."""

    def __init__(self, at: int, rows: pa.Table, models: Models, cosine: float, reach: float):
        self.at, self.cosine = at, cosine
        self.node, self.copies = (rows.column(c).to_numpy() for c in ("node", "copies"))
        self.x = _matrix(rows.column("vector"), np.float64)
        self.quantiser, self.first = models.of_list(at) if at >= 0 else (None, 0)
        if self.quantiser is not None:
            self.codes, self.bits = _matrix(rows.column("code"), np.uint8), _matrix(rows.column("bits"), np.uint8)
            self.most = ((reach + rows.column("error").to_numpy() + SLACK) ** 2).astype(np.float32)
        self.label = np.arange(len(self.node))
        self.links = np.zeros(len(self.node), dtype=np.int64)

    def meet(self, node: np.ndarray, home: np.ndarray, copies: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Numbers of rows that each query is linked to, and the edges of a spanning forest."""
        if self.quantiser is None:
            r, c = np.divmod(np.arange(len(node) * len(self.node)), len(self.node))
        else:
            c, r = np.nonzero(self.quantiser.distances(x, self.at - self.first, self.codes) <= self.most[:, None])
            order = np.argsort(r, kind="stable")
            r, c = r[order], c[order]
        fine = np.where(home[r] == self.at, node[r] < self.node[c], True)
        late = np.flatnonzero(home[r] > self.at)  # counted where the lesser list probes, if it does
        if len(late):
            fine[late] = self.bits[c[late], home[r[late]] >> 3] >> (home[r[late]] & 7) & 1 == 0
        r, c = r[fine], c[fine]
        near = np.empty(len(r), dtype=bool)
        if 10 * len(r) > len(node) * len(self.node):
            near = (x @ self.x.T)[r, c] >= self.cosine
        else:
            for lo in range(0, len(r), 65_536):
                near[lo : lo + 65_536] = np.einsum("ij,ij->i", x[r[lo : lo + 65_536]], self.x[c[lo : lo + 65_536]]) >= self.cosine
        r, c = r[near], c[near]
        np.add.at(self.links, c, copies[r])
        edges = []
        bounds = np.searchsorted(r, np.arange(len(node) + 1))
        for i in np.unique(r).tolist():
            own = c[bounds[i] : bounds[i + 1]]
            labels, first = np.unique(self.label[own], return_index=True)
            edges += [(int(node[i]), int(self.node[k])) for k in own[first]]
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]
        return np.bincount(r, weights=self.copies[c], minlength=len(node)).astype(np.int64), edges


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


#: src and dst of an edge, or a node and the number of rows that it is linked to.
FOUND = "src long, dst long, links long"


def search(coded: DataFrame, models: Models, cosine: float, reach: float, part: int = PART, block: int = BLOCK) -> DataFrame:
    """Edges of spanning forests (src, dst) and numbers of linked rows (src, links; a node has many such rows)."""
    spark = coded.sparkSession
    asked = coded.select("node", "copies", "list", "vector", F.explode("asked").alias("at"))
    members, queries = coded.groupBy(F.col("list").alias("at")).agg(F.count("*").alias("members")), asked.groupBy("at").agg(F.count("*").alias("queries"))
    sizes, _ = written(spark, members.join(queries, "at").select("at", F.ceil(F.col("members") / part).cast("int").alias("parts"), F.ceil(F.col("queries") / block).cast("int").alias("blocks")), "list-sizes")
    if sizes.count() <= BROADCAST_ROWS:
        sizes = F.broadcast(sizes)
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    held = coded.withColumnRenamed("list", "at").join(sizes, "at").select("at", deal("parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "node", "copies", F.col("at").alias("home"), "vector", "code", "error", "bits")
    none = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("code", "error", "bits")]
    come = asked.join(sizes, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), deal("blocks").alias("block"), F.lit(1).alias("kind"), "node", "copies", F.col("list").alias("home"), "vector", *none)
    keys = ["at", "part", "block"]
    rows = held.unionByName(come).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(src: list, dst: list, links: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (src, dst, links)], names=["src", "dst", "links"])

        def counted(node: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(links)
            return out(node[some], pa.nulls(len(some), pa.int64()), links[some])

        key, waiting, held = None, [], None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(4)]
            cuts = (np.flatnonzero(np.any([v[1:] != v[:-1] for v in columns], axis=0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                here = tuple(int(v[lo]) for v in columns[:3])
                if here != key:
                    if held is not None:
                        yield counted(held.node, held.links)
                    key, waiting, held = here, [], None
                if columns[3][lo] == 0:
                    waiting.append(batch.slice(lo, hi - lo))
                    continue
                if held is None and waiting:
                    held, waiting = Members(here[0], pa.Table.from_batches(waiting), models, cosine, reach), []
                if held is None:  # a part without members
                    continue
                for at in range(lo, hi, STEP):
                    q = batch.slice(at, min(STEP, hi - at))
                    node, home, copies = (q.column(c).to_numpy() for c in ("node", "home", "copies"))
                    n, edges = held.meet(node, home, copies, _matrix(q.column("vector"), np.float64))
                    yield counted(node, n)
                    if edges:
                        yield out([e[0] for e in edges], [e[1] for e in edges], [None] * len(edges))
        if held is not None:
            yield counted(held.node, held.links)

    return rows.mapInArrow(run, FOUND)


def link_classes(spark: SparkSession, embeddings: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row of ``embeddings`` with n_links (other rows of at least that cosine) and component_id (the least key reachable).

    Null, empty and zero vectors and those with a null or non-finite component link with nothing; so do vectors of
    another number of dimensions. Repeated rows are rows of their own, linked with each other. A null key names no
    component unless all its keys are null. Columns of the names added are replaced; an empty table stays one. Of a vector
    of any length only its codes and its unit vector travel.
    """
    ship_package(spark)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    kept = without(embeddings, "n_links", "component_id")
    plain = F.col(f"`{vector}`").cast("array<double>")
    rows = kept.select(F.col(f"`{key}`").alias("key"), plain.alias("embedding")).where(usable(F.col("embedding")))
    grouped = rows.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("key").alias("least"))
    vectors, _ = written(spark, grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")
    models = fit(vectors)
    coded, _ = written(spark, encode(vectors, models, reach), "codes")
    found, _ = written(spark, search(coded, models, cosine, reach), "found-links")
    labels = connected_components(spark, found.where("dst IS NOT NULL").select("src", "dst"))
    links = found.where("dst IS NULL").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    named = vectors.join(labels, "node", "left").join(links, "node", "left").select("embedding", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(least, "component").select(F.xxhash64("embedding").alias("__h"), F.col("embedding").alias("__v"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    fine = usable(plain)
    asked = kept.withColumn("__v0", F.when(fine, plain)).withColumn("__h0", F.xxhash64("__v0"))
    out = asked.join(told, (F.col("__h0") == F.col("__h")) & (F.col("__v0") == F.col("__v")), "left")
    return out.select(*[F.col(f"`{c}`") for c in kept.columns], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("__v0").isNull(), F.col(f"`{key}`")).otherwise(F.col("component_id")).alias("component_id"))


def op13(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    out = link_classes(spark, embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
