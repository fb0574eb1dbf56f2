"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A merge model joins, again and again, the adjacent pair whose joined piece has the best score. The result is the one
segmentation in which every adjacent pair of pieces, merged anew from characters, gives that very pair. So instead of
merging whole texts, the encoder walks from left to right:

* an Aho-Corasick automaton over the pieces proposes the longest match at each position;
* a piece is taken if re-merging it together with its left neighbour gives the two back (answers are kept);
* otherwise the next shorter piece is tried; a position from which nothing fits is marked in a bitfield of failed
  positions, the last piece is taken back, and no other path enters a marked position again.

No piece of such a model holds a space mark after another character, so texts fall apart at the start of each run of
spaces, and so do words where no piece holds two characters next to each other (letters and marks, say). The encodings of
what is between such places are kept in a bounded table: there are far fewer different ones than words. Runs of spaces have
pieces of equal score, merged from the left; they are handled on their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.llm.common import ship_package, without

SPACE = "▁"
#: Stretches whose encodings a worker keeps (and words, of texts with runs of spaces), and pairs of pieces: half as new ones, half as what was new before.
KEPT_WORDS = 200_000
KEPT_PAIRS = 200_000
#: Text that is worked on at a time: a decoded byte takes some 17 bytes on the way.
STEP_BYTES = 1 << 18


class PieceModel:
    """The pieces and scores of a SentencePiece merge model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.text: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        spaces: dict[int, int] = {}
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            if lib.is_control(i) or lib.is_unknown(i):
                self.text.append(b"" if lib.is_control(i) else " ⁇ ".encode())
                continue
            self.text.append(piece.replace(SPACE, " ").encode())
            if set(piece) == {SPACE}:
                spaces[len(piece)] = i
            if len(piece) > 1 and set(piece) == {SPACE}:
                continue
            if SPACE in piece[1:]:
                raise ValueError("a piece holds a space mark inside; words can't be encoded one by one")
            self.ids[piece] = i
            self.score[piece] = lib.get_score(i)
        if len(self.byte_id) != 256 or SPACE not in self.ids:
            raise ValueError("a merge model with byte fallback and a space piece is needed")
        self.space_ids = spaces
        self.single = {p for p in self.ids if len(p) == 1}
        loose = {c for p in self.ids for c in p} - self.single
        if loose:
            raise ValueError("characters that are in pieces, but aren't pieces")
        self.usable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.usable:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.usable))
        self.shorter: dict[str, str | None] = {}
        for p in self.usable:
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.usable), None)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.old_pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.stretches = re.compile(f"{SPACE}?(?:{'|'.join([*map(self._any_of, self._joined()), '.'])})|{SPACE}", re.DOTALL).findall

    @staticmethod
    def _any_of(chars: set[str]) -> str:
        return f"[{''.join(map(re.escape, sorted(chars)))}]+"

    def _joined(self) -> list[set[str]]:
        """Sets of characters: pieces hold characters of different sets, or of none, never next to each other but for a space mark in front."""
        of: dict[str, set[str]] = {}
        for a, b in {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}:
            if a != SPACE:
                both = of.get(a, {a}) | of.get(b, {b})
                of |= dict.fromkeys(both, both)
        return list({id(x): x for x in of.values()}.values())

    def merge(self, text: str) -> list[str]:
        """Merge characters as the model defines it; for short strings."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two pieces, merged anew from their characters, come out as they are."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS // 2:
                self.old_pairs, self.pairs = self.pairs, {}
            known = self.old_pairs.get(key)
            if known is None:
                known = self.merge(left + right) == [left, right]
            self.pairs[key] = known
        return known

    def run(self, n: int) -> list[int]:
        """Ids of n spaces that no word takes up: equal scores, so the leftmost pair merges first."""
        known = self.runs.get(n)
        if known is None:
            done: list[int] = []
            for _ in range(n):
                done.append(1)
                while len(done) > 1 and done[-2] + done[-1] in self.space_ids:
                    last = done.pop()
                    done[-1] += last
            known = [self.space_ids[x] for x in done]
            if len(self.runs) < 10_000 and n < 10_000:
                self.runs[n] = known
        return known

    def walk(self, word: str) -> list[str]:
        """Pieces of a word whose characters are all known, by backtracking."""
        n = len(word)
        best: list[str | None] = [None] * n
        for end, (back, p) in self.automaton.iter(word):  # by their ends, so the last one from a place is the longest
            best[end - back] = p
        shorter, fits, known = self.shorter, self.fits, self.pairs.get
        taken: list[str] = []
        at, failed, p, last = 0, 0, best[0], None
        while True:
            while p is not None:
                if not (failed and failed >> (at + len(p)) & 1):
                    if last is None:
                        break
                    ok = known((last, p))
                    if ok is None:
                        ok, known = fits(last, p), self.pairs.get
                    if ok:
                        break
                p = shorter[p]
            if p is None:
                failed |= 1 << at
                p = taken.pop()
                last = taken[-1] if taken else None
                at -= len(p)
                p = shorter[p]
                continue
            taken.append(p)
            at += len(p)
            if at == n:
                return taken
            p, last = best[at], p

    def pieces(self, word: str) -> list[str]:
        """Pieces of a word with its space mark; a character without a piece stands for itself."""
        if self.single.issuperset(word):
            return self.walk(word)
        out: list[str] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.single:
                if start < i:
                    out += self.walk(word[start:i])
                out.append(c)
                start = i + 1
        return out + (self.walk(word[start:]) if start < len(word) else [])

    def word_ids(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(word):
            i = self.ids.get(p)
            if i is None:
                out += [self.byte_id[b] for b in p.encode()]
            else:
                out.append(i)
        return out


class _Kept(dict):
    """Text -> its ids as little-endian int32 bytes; a full table becomes the old one, and what is asked of that one is kept on."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.encode(text)
        if len(text) <= 200:
            if len(self) >= KEPT_WORDS // 2:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class PieceCodec:
    """encode(text) and decode(ids), equal to the sentencepiece library's without begin, end and sampling."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.words = _Kept(lambda w: b"".join(map(self.texts.__getitem__, self.model.stretches(SPACE + w))))
        self.texts = _Kept(lambda t: np.array(self.model.word_ids(t), dtype="<i4").tobytes())
        sizes = np.array([len(t) for t in self.model.text], dtype=np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(self.model.text), dtype=np.uint8)
        self.space = np.array([self.model.ids[SPACE]], dtype="<i4").tobytes()

    def parts(self, text: str) -> list[bytes]:
        """Ids of each stretch or word, as bytes, in order."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if not (text[0] == SPACE or text[-1] == SPACE or SPACE * 2 in text):
            return list(map(self.texts.__getitem__, self.model.stretches(SPACE + text)))
        words = text.split(SPACE)
        out: list[bytes] = []
        bare = 0
        run = self.model.run
        as_bytes = lambda ids: np.array(ids, dtype="<i4").tobytes()
        for w in words:
            if not w:
                bare += 1
                continue
            ids = self.words[w]
            if bare:
                if ids[:4] == self.space:  # the word doesn't take up its own space mark
                    bare, ids = bare + 1, ids[4:]
                out.append(as_bytes(run(bare)))
                bare = 0
            out.append(ids)
        if bare:
            out.append(as_bytes(run(bare)))
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.parts(text)), dtype="<i4").tolist()

    def decode_all(self, texts: list[bytes]) -> list[str]:
        """The texts of ids given as little-endian int32 bytes; bytes that aren't UTF-8 become U+FFFD, the first space mark goes."""
        ids = np.frombuffer(b"".join(texts), dtype="<i4")
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - ends[:-1], sizes)
        at += np.arange(ends[-1])
        out = self.bytes[at].tobytes()
        cuts = ends[np.cumsum([0, *[len(t) // 4 for t in texts]])].tolist()
        return [out[lo + (out[lo : min(lo + 1, hi)] == b" ") : hi].decode("utf-8", "replace") for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def decode_parts(self, parts: list[bytes]) -> str:
        return self.decode_all([b"".join(parts)])[0]

    def decode(self, ids: list[int]) -> str:
        return self.decode_parts([np.array(ids, dtype="<i4").tobytes()])


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``STEP_BYTES`` of text, at least a row each: they bound the memory of a batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + STEP_BYTES, side="right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


def encode_decode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text and the text that these ids decode to.

    A null text counts as an empty one: no ids, empty decoded text. Columns named like the new ones are replaced;
    others stay. Runs map-side only: no shuffle, memory bounded by one Arrow batch and the kept words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    kept = without(docs, *(c for c in (ids, decoded) if c.lower() != text.lower()))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            whole = batch.column(batch.schema.get_field_index(text))
            for lo, hi in steps(whole):
                part = batch.slice(lo, hi - lo)
                joined = [b"".join(c.parts(t or "")) for t in whole.slice(lo, hi - lo).to_pylist()]
                offsets = np.zeros(len(joined) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in joined], out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(joined), dtype="<i4"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(c.decode_all(joined), pa.string())],
                    names=[*part.schema.names, ids, decoded],
                )

    return kept.mapInArrow(run, schema)


def op1(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    out = encode_decode(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
