"""Token ids of whole texts, written in ascending key order as Simple-8b segments, and read back.

A segment is one row of the files: whole documents in order, their ids coded by :mod:`clinspark.llm.simple8b`. Spark's
own writer commits the files, so a lost executor leaves no half-written output, and any store that Spark can write will
do.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.llm import simple8b
from clinspark.llm.common import ship_package, written

#: Words that a worker keeps; beyond it, those met more than once stay, half of the table at most.
KEPT_WORDS = 300_000
#: Bytes of text that are tokenized at a time; a longer text is on its own.
STEP_BYTES = 1 << 21
#: Ids that a segment holds before it is closed; a longer document still lies in one segment.
SEGMENT_IDS = 1 << 17
#: Texts that can't be taken word by word: characters beyond Latin-1, controls and spaces on whose meaning Arrow and the
#: tokenizer may differ, and what may be a special token.
ODD = "[^\\t-\\r\\x20-\\x7e\\x{a1}-\\x{ff}]|<\\|"
#: Letters, as the tokenizer's pattern takes them, and other characters after them: always a border between tokens.
LETTER = "a-zA-Z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}"
BORDER = f"([{LETTER}])([^{LETTER}\\s])"


class WordTokenizer:
    """The tokenizers library behind a bounded table of words.

    The tokenizer drops white space, folds case and never looks across white space or past the end of a run of letters, so
    the ids of a text are those of its lower-case words. Arrow splits the texts and numbers their different words; only
    words that the table lacks are tokenized, and the ids of all occurrences are gathered by their numbers at once. Odd
    texts go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        # Bytes as the model's characters: printable ones stand for themselves, the others follow from 256 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = iter(range(256, 512))
        self.characters = {b: b if b in plain else next(other) for b in range(256)}
        #: Word -> its number in ``sizes`` and ``met``; ``ids`` holds the words' ids one after another.
        self.number: dict[str, int] = {}
        self.sizes = np.zeros(0, dtype=np.int64)
        self.met = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype="<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> None:
        """Give words numbers. Of letters alone, the model decides; the others go to the library in one call."""
        letters = [w for w in missing if w.isalpha()]
        others = [w for w in missing if not w.isalpha()]
        model, sizes, ids = self.lib.model, array("q"), array("I")
        if letters:
            for w in " ".join(letters).encode().decode("latin-1").translate(self.characters | {32: 32}).split(" "):
                tokens = [t.id for t in model.tokenize(w)]
                sizes.append(len(tokens))
                ids.extend(tokens)
        rest = self.whole(others)
        self.number.update(zip(letters + others, range(len(self.sizes), len(self.sizes) + len(missing)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.frombuffer(sizes, np.int64), np.array([len(x) for x in rest], dtype=np.int64)])
        self.met = np.concatenate([self.met, np.zeros(len(missing), dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, "<u4"), *rest])

    def forget(self) -> None:
        """Keep the words met more than once, and of these half a table of the most frequent."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > KEPT_WORDS // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[: KEPT_WORDS // 2]])
        words = list(self.number)  # in order of their numbers
        self.number = {words[i]: n for n, i in enumerate(keep.tolist())}
        stay = np.zeros(len(self.sizes), dtype=bool)
        stay[keep] = True
        self.ids = self.ids[np.repeat(stay, self.sizes)]
        self.sizes, self.met = self.sizes[keep], self.met[keep]

    def look_up(self, words: list[str]) -> np.ndarray:
        """Numbers of different words."""
        if len(self.number) > KEPT_WORDS:
            self.forget()
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = [words[i] for i in missing]
            self.learn(new)
            found[missing] = np.fromiter(map(self.number.__getitem__, new), np.int64, len(new))
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; a null text counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.utf8_lower(pc.if_else(odd, "", texts))
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(plain, BORDER, "\\1 \\2"))
        coded = split.flatten().dictionary_encode()
        number = self.look_up(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        self.met[number] += np.bincount(index, minlength=len(number))
        starts = (np.cumsum(self.sizes) - self.sizes)[number]
        per = self.sizes[number][index]
        ends = np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(per, out=ends[1:])
        ids = self.ids[np.repeat(starts[index] - ends[:-1], per) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        out = [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, x in zip(at, self.whole([texts[i].as_py() for i in at]), strict=True):
            out[i] = x
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``STEP_BYTES`` together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP_BYTES, side="right")))
        yield lo, hi
        lo = hi


SEGMENTS = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("local_start", T.LongType(), False),
        T.StructField("n_ids", T.LongType(), False),
        T.StructField("keys", T.ArrayType(T.LongType(), True), False),
        T.StructField("lengths", T.ArrayType(T.LongType(), False), False),
        T.StructField("payload", T.BinaryType(), False),
    ]
)


def segments(docs: DataFrame, path: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of ``docs`` in ascending key order (null keys first; equal keys by their text's hash).

    One shuffle, by ranges of the key and the text's hash, so that a key of many rows is split; then each task sorts, tokenizes and packs its range. Null texts count as empty.
    Repeated rows are written as often as they occur; an empty table has no segments. Keys are whole numbers.
    """
    ship_package(docs.sparkSession)
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"the key {key} is no whole number")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first(), F.xxhash64("text"))
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part = tokenizer(path), TaskContext.get().partitionId()
        start = held = 0
        keys: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            data = np.concatenate(ids)
            row = {"part": part, "local_start": start - len(data), "n_ids": len(data), "keys": keys, "lengths": lengths, "payload": simple8b.to_bytes(simple8b.encode(data))}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in batches:
            for lo, hi in steps(batch.column(1)):
                for k, x in zip(batch.column(0)[lo:hi].to_pylist(), t.encode(batch.column(1)[lo:hi]), strict=True):
                    keys.append(k)
                    lengths.append(len(x) + len(end))
                    ids += (x, end)
                    start += lengths[-1]
                    held += lengths[-1]
                    if held >= SEGMENT_IDS:
                        yield close()
                        keys, lengths, ids, held = [], [], [], 0
        if keys:
            yield close()

    return rows.mapInArrow(run, SEGMENTS)


def with_starts(segs: DataFrame) -> DataFrame:
    """Segments with ``start``: the ids of all that comes before them. Parts are few: one row for each output task."""
    parts = segs.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return segs.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read_documents(segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and ids (little-endian unsigned 32-bit integers) of each document of the segments."""
    ship_package(segs.sparkSession)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("start", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, keys, lengths, payload = (batch.column(i)[row].as_py() for i in range(4))
                ids = simple8b.decode(simple8b.from_bytes(payload)).astype("<u4").tobytes()
                n = np.array(lengths, dtype=np.int64)
                ends = np.cumsum(n)
                cut = [ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths, strict=True)]
                for lo in range(0, len(keys), 512):
                    hi = lo + 512
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.int64()), pa.array(start + (ends - n)[lo:hi]), pa.array(n[lo:hi]), pa.array(cut[lo:hi], pa.binary())], names=[key, "start", "n_tokens", "ids"])

    return segs.select("start", "keys", "lengths", "payload").mapInArrow(run, schema)


def write_and_read(spark: SparkSession, docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    files, _ = written(spark, segments(docs, path, end_id), "tokens")
    return read_documents(with_starts(files))


def op7(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the written files."""
    out = write_and_read(spark, docs, path, end_id)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
