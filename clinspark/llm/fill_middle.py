"""Fill-in-the-middle: texts cut at two token borders and put together anew, the cuts found by a parallel automaton scan.

Tokens are runs of white space with the word that follows, or white space at the end. The automaton that counts them has
three states: at the start, in white space, in a word. A chunk of a text is a function: for each state that may come in, the
state that goes out and the number of tokens that begin. Functions compose associatively, so a prefix scan gives the state
and the count before each chunk, wherever the chunks lie; a cut is then looked for in the one chunk that holds it.

Texts of up to ``GIANT`` bytes are scanned where they lie. Beyond, their chunks are dealt out as rows: tasks turn chunks into
functions, the functions of a text (a few numbers each) are composed in order, and the chunks that hold a cut are picked by
a join. The table of chunks is written to the shared folder, so nothing is scanned twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.llm.common import ship_package, without, written

CHUNK = 1 << 14
GIANT = 1 << 16
RATE, SPM = 50, 80
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}

START, SPACE, WORD = 0, 1, 2
#: Per class of byte (other, white space): the state that follows, whatever came in, and per state whether a token begins.
NEXT = np.array([WORD, SPACE], dtype=np.int8)
BEGINS = np.array([[1, 1], [0, 0], [0, 1]], dtype=np.int64)
WHITE = np.zeros(256, dtype=np.int8)
WHITE[[9, 10, 11, 12, 13, 32]] = 1


def begins(data: np.ndarray, state: int) -> np.ndarray:
    """Where tokens begin in a chunk (bytes of UTF-8; not empty) that is entered in ``state``."""
    kinds = WHITE[data]
    return np.flatnonzero(BEGINS[np.concatenate([[state], NEXT[kinds[:-1]]]), kinds])


def function_of(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a chunk: the state that goes out and the tokens that begin, for each state that comes in. Empty: the identity."""
    if not len(data):
        return [START, SPACE, WORD], [0, 0, 0]
    kinds = WHITE[data]
    later = int(BEGINS[NEXT[kinds[:-1]], kinds[1:]].sum())
    return [int(NEXT[kinds[-1]])] * 3, [later + int(b) for b in BEGINS[:, kinds[0]]]


def compose(outs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix scan of chunk functions (rows), in as many steps as doublings: row i is the function of chunks 0 to i."""
    outs, counts, step = outs.copy(), counts.copy(), 1
    while step < len(outs):
        first, n = outs[:-step], counts[:-step]
        counts[step:] = n + np.take_along_axis(counts[step:], first, 1)
        outs[step:] = np.take_along_axis(outs[step:], first, 1)
        step *= 2
    return outs, counts


def entries(functions: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """State and tokens before each chunk of a text, and at its end."""
    outs, counts = compose(np.array([f[0] for f in functions], dtype=np.int64), np.array([f[1] for f in functions], dtype=np.int64))
    return np.concatenate([[START], outs[:, START]]), np.concatenate([[0], counts[:, START]])


def cut_ranks(n: int, h1: int, h2: int) -> tuple[int, int]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b)


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero(data & 0xC0 != 0x80))


def cuts(data: np.ndarray, h1: int, h2: int, chunk: int = CHUNK) -> tuple[int, int, int]:
    """Number of tokens, and the characters before the two cuts."""
    parts = [data[lo : lo + chunk] for lo in range(0, len(data), chunk)] or [data]
    states, counts = entries([function_of(p) for p in parts])
    n = int(counts[-1])
    found = []
    for rank in cut_ranks(n, h1, h2):
        if rank == n:
            found.append(characters(data))
        else:
            at = int(np.searchsorted(counts, rank, "right")) - 1
            found.append(characters(data[: at * chunk + int(begins(parts[at], int(states[at]))[rank - counts[at]])]))
    return n, found[0], found[1]


def _scanned(text: Column, h1: Column, h2: Column) -> Column:
    """Tokens and cuts of whole texts, scanned where they lie."""

    @F.arrow_udf("struct<n: long, a: long, b: long>")
    def scan(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        rows = [cuts(np.frombuffer(t.encode(), np.uint8), x, y) for t, x, y in zip(texts.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["n", "a", "b"])

    return scan(text, h1, h2)


def giant_cuts(spark: SparkSession, giants: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """mark, n, a and b of each row of ``giants`` (mark, text, h1, h2; marks differ), chunks dealt out over all tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                for lo in range(0, len(data), chunk * 64):
                    some = [data[i : i + chunk] for i in range(lo, min(len(data), lo + chunk * 64), chunk)]
                    yield pa.RecordBatch.from_arrays([pa.array([mark] * len(some)), pa.array(range(lo // chunk, lo // chunk + len(some)), pa.int32()), pa.array(some, pa.binary())], names=["mark", "no", "data"])

    pieces = giants.select("mark", "text").mapInArrow(split, "mark string, no int, data binary").repartition("mark", "no")
    pieces, _ = written(spark, pieces, "chunks")

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.frombuffer(d, np.uint8) for d in batch.column(2).to_pylist()]
            made = [function_of(d) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([characters(d) for d in data], pa.int64()), pa.array([f[0] for f in made], pa.list_(pa.int64())), pa.array([f[1] for f in made], pa.list_(pa.int64()))], names=["mark", "no", "chars", "outs", "counts"])

    summed = pieces.mapInArrow(functions, "mark string, no int, chars long, outs array<long>, counts array<long>")
    hashes = giants.select("mark", "h1", "h2")
    rows = summed.join(hashes, "mark").repartition("mark").sortWithinPartitions("mark", "no").select("mark", "no", "chars", "outs", "counts", "h1", "h2")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each cut of a text: the chunk that holds it, what comes in there, and the token to look for."""

        def found(text: list[tuple]) -> pa.RecordBatch:
            states, counts = entries([(r[3], r[4]) for r in text])
            before = np.concatenate([[0], np.cumsum([r[2] for r in text])])
            n, out = int(counts[-1]), []
            for which, rank in enumerate(cut_ranks(n, text[0][5], text[0][6])):
                at = len(text) if rank == n else int(np.searchsorted(counts, rank, "right")) - 1
                out.append((text[0][0], which, n, -1 if rank == n else at, int(states[at]), int(rank - counts[at]), int(before[at])))
            return pa.RecordBatch.from_pylist([dict(zip(PICK.names, r, strict=True)) for r in out], schema=PICK)

        text: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and text[0][0] != row[0]:
                    yield found(text)
                    text = []
                text.append(row)
        if text:
            yield found(text)

    picks = rows.mapInArrow(resolve, "mark string, which int, n long, no int, state int, rank long, before long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for state, rank, before, data in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                if data is None:
                    at.append(before)
                else:
                    d = np.frombuffer(data, np.uint8)
                    at.append(before + characters(d[: begins(d, state)[rank]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at, pa.int64())], names=["mark", "which", "n", "at"])

    held = picks.join(pieces, ["mark", "no"], "left").select("mark", "which", "n", "state", "rank", "before", "data")
    placed = held.mapInArrow(place, "mark string, which int, n long, at long")
    return placed.groupBy("mark").agg(F.max("n").alias("n"), F.max(F.when(F.col("which") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("at"))).alias("b"))


PICK = pa.schema([("mark", pa.string()), ("which", pa.int32()), ("n", pa.int64()), ("no", pa.int32()), ("state", pa.int32()), ("rank", pa.int64()), ("before", pa.int64())])
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, giant: int = GIANT) -> DataFrame:
    """``docs`` with n (tokens of the whole text), form, prefix_chars, middle_chars and output; columns of those names are replaced.

    Key and seed decide form and cuts. A null or empty text is plain with an empty output, as is a null key's hash that of
    an empty key; a text that holds a mark is plain as it is. Repeated rows come out alike, an empty table stays one.
    """
    ship_package(spark)
    kept = without(docs, *ADDED)
    name, whole = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)
    rows = kept.withColumns({"__d": digest, "__t": whole})
    for i in range(4):
        rows = rows.withColumn(f"__h{i + 1}", F.conv(F.substring("__d", 8 * i + 1, 8), 16, 10).cast("long"))
    held = F.lit(False)
    for m in MARKS.values():
        held = held | F.contains("__t", F.lit(m))
    plain = (F.col("__t") == "") | held | (F.col("__h3") % 100 >= RATE)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("__h4") % 100 < SPM, "spm").otherwise("psm"))

    large = F.octet_length("__t") > giant
    mark = F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, F.lit(":"), F.col("__t")), 256)
    giants = rows.where(large).withColumn("__mark", mark)
    once = giants.select(F.col("__mark").alias("mark"), F.col("__t").alias("text"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2")).dropDuplicates(["mark"])
    at = giant_cuts(spark, once).select(F.col("mark").alias("__mark"), F.struct("n", "a", "b").alias("__cut"))
    small = rows.where(~large).withColumn("__cut", _scanned(F.col("__t"), F.col("__h1"), F.col("__h2")))
    both = small.unionByName(giants.join(at, "__mark").drop("__mark"))

    a, b = F.col("__cut.a").cast("int"), F.col("__cut.b").cast("int")
    t = F.col("__t")
    prefix, middle, suffix = F.substr(t, F.lit(1), a), F.substr(t, a + 1, b - a), F.substr(t, b + 1)
    p, s, m = (F.lit(MARKS[k]) for k in ("prefix", "suffix", "middle"))
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return both.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("__cut.n").alias("n"), "form", F.when(cut, a.cast("long")).alias("prefix_chars"), F.when(cut, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: marks cannot occur in its parts."""
    parts = F.split(output, "<[" + "".join(m[1] for m in MARKS.values()) + "]>", -1)
    order = F.when(form == "psm", F.array(F.lit(1), F.lit(3), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3), F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.array_join(F.transform(order, lambda i: F.get(parts, i)), ""))


def op11(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text of every document."""
    made = fill_in_middle(spark, docs.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
