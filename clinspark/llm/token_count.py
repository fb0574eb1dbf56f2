"""Token counts by a compiled finite-state transducer and composed chunk maps.

The transducer reads characters and emits, on each transition, by how many tokens the count of the text so far changes
(the encoding of a longer prefix may also have fewer tokens). A state holds all that a later token may start from: for
each earlier position from which the characters since are the start of some piece, those characters, the token that
ends there and its count relative to now. Both are bounded by the longest piece, so the states are finitely many; they
are determinised as texts need them and kept in a bounded table, which starts anew even inside a word.

A long text is cut into chunks anywhere. A chunk's map takes the state that comes in to the state that goes out and the
tokens emitted between (:class:`ChunkMap`). Where a run of spaces begins, the state no longer depends on what came in, so
only the head before the first such place does; the rest is counted once. A head, or a chunk without such a place, is run
from a supposed state beforehand, and its first states are kept: run from any other state it soon falls into step with
that run, from where on its count is known. Maps compose (:meth:`TokenCounter.compose`), composition is associative, and
:meth:`TokenCounter.scan` gives the state and count before each chunk by a parallel prefix scan: up the tree of
compositions, down with the states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.llm.common import ship_package, without
from clinspark.llm.piece_bpe import SPACE, PieceModel

KEPT_STATES = 200_000
KEPT_WORDS = 400_000
CHUNK = 16_384
#: States kept of the run of a span from the supposed state.
TRAIL = 128
#: Opened positions: (characters since, token before, count relative to now, whether the word's first token is its space mark alone).
Opened = tuple[tuple[str, str | None, int, bool], ...]
#: What comes before a place: spaces that no word has taken up yet, and the transducer's state inside a word (None: outside).
State = tuple[int, Opened | None]
START: Opened = (("", None, 0, False),)
OUTSIDE: State = (0, None)


class Transducer:
    """Deterministic transitions with emitted-token counts, compiled from a merge model."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.starts = {p[:k] for p in model.usable for k in range(1, len(p))}
        self.reset()

    def reset(self) -> None:
        self.open: list[Opened] = []
        self.number: dict[Opened, int] = {}
        self.step: dict[tuple[int, str], tuple[int, int]] = {}

    def _state(self, opened: Opened) -> int:
        n = self.number.get(opened)
        if n is None:
            n = self.number[opened] = len(self.open)
            self.open.append(opened)
        return n

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """The flag says that the first token is a lone space mark, which then belongs to the run before it."""
        usable, fits = self.model.usable, self.model.fits
        now, ahead = None, []
        for since, before, count, lone in self.open[state]:
            s = since + c
            if now is None and s in usable and (before is None or fits(before, s)):
                now = (s, count + 1, s == SPACE if before is None else lone)
            if s in self.starts:
                ahead.append((s, before, count, lone))
        if now is None:  # no piece: the character's bytes
            here = self.open[state][-1]
            now, ahead = (c, here[2] + len(c.encode()), here[3]), []
        token, count, lone = now
        opened = (*((s, b, n - count, f) for s, b, n, f in ahead), ("", token, 0, lone))
        return self._state(opened), count

    def run(self, text: str, opened: Opened) -> tuple[Opened, int]:
        """The state after the text and the tokens emitted on the way."""
        state, step, total = self._state(opened), self.step, 0
        for c in text:
            to = step.get((state, c))
            if to is None:
                if len(self.open) > KEPT_STATES:
                    opened = self.open[state]
                    self.reset()
                    state, step = self._state(opened), self.step
                to = step[state, c] = self._compile(state, c)
            state, n = to
            total += n
        return self.open[state], total

    def word(self, word: str) -> tuple[int, bool]:
        """Tokens of a word with its space mark, and whether the mark stays alone."""
        opened, n = self.run(SPACE + word, START)
        return n, opened[-1][3]


class _Counts(dict):
    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine = machine

    def __missing__(self, word: str) -> int:
        """Tokens of a word; a lone space mark shows as a negative number."""
        if len(self) >= KEPT_WORDS:
            self.clear()
        n, lone = self.machine.word(word)
        n = -n if lone else n
        if len(word) <= 200:
            self[word] = n
        return n


class Span(NamedTuple):
    """Characters inside a word, run from the supposed state: the first states and counts, the last state and the count."""

    text: str
    trail: tuple[tuple[Opened, int], ...]
    out: Opened
    count: int


class ChunkMap(NamedTuple):
    """From the state that comes in to the state that goes out, and the tokens emitted between.

    ``head``: numbers of spaces and spans, to be followed from the state that comes in. ``settled``: a run of spaces begins
    after the head; then ``count`` tokens follow, and the state is ``out``, whatever came in.
    """

    head: tuple[int | Span, ...]
    settled: bool
    count: int
    out: State


class TokenCounter:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.machine = Transducer(self.model)
        self.counts = _Counts(self.machine)

    def spaced(self, text: str) -> int:
        """Tokens of text that begins with a space mark and ends with a word or a run (spaces as ' ')."""
        if not text:
            return 0
        words = text[1:].split(" ")
        if "" not in words:
            return sum(map(abs, map(self.counts.__getitem__, words)))
        total = bare = 0
        run = self.model.run
        for w in words:
            if not w:
                bare += 1
                continue
            n = self.counts[w]
            if bare:
                total += len(run(bare + 1)) - 1 if n < 0 else len(run(bare))
                bare = 0
            total += abs(n)
        return total + (len(run(bare)) if bare else 0)

    def span(self, text: str) -> Span:
        opened, total, trail = ((("", SPACE, 0, False),)), 0, []
        for c in text[:TRAIL]:
            opened, n = self.machine.run(c, opened)
            total += n
            trail.append((opened, total))
        opened, n = self.machine.run(text[TRAIL:], opened)
        return Span(text, tuple(trail), opened, total + n)

    def through(self, span: Span, opened: Opened) -> tuple[Opened, int]:
        """A span from any state: until it falls into step with the run from the supposed state."""
        flags = {x[3] for x in opened}
        if flags == {True}:  # the flag is only handed on, so it may be put aside
            out, n = self.through(span, tuple((*x[:3], False) for x in opened))
            return tuple((*x[:3], True) for x in out), n
        run, total = self.machine.run, 0
        for c, (known, n) in zip(span.text, span.trail, strict=False):
            opened, m = run(c, opened)
            total += m
            if opened == known:
                return span.out, total + span.count - n
        opened, m = run(span.text[len(span.trail) :], opened)
        return opened, total + m

    def ended(self, bare: int, opened: Opened) -> int:
        """Tokens that the end of a word settles: the spaces before it, with its own mark if that stayed alone."""
        if not bare:
            return 0
        return len(self.model.run(bare + 1)) - 1 if opened[-1][3] else len(self.model.run(bare))

    def finish(self, state: State) -> int:
        """Tokens that the end of the text settles."""
        bare, opened = state
        if opened is not None:
            return self.ended(bare, opened)
        return len(self.model.run(bare)) if bare else 0

    def follow(self, state: State, steps: tuple[int | Span, ...]) -> tuple[State, int]:
        total = 0
        for step in steps:
            bare, opened = state
            if isinstance(step, int):
                if opened is None:
                    state = (bare + step, None)
                else:
                    total += self.ended(bare, opened)
                    state = (step, None)
                continue
            if opened is None:
                bare -= 1
                opened, n = self.machine.run(SPACE, START)
                total += n
            opened, n = self.through(step, opened)
            total += n
            state = (bare, opened)
        return state, total

    def steps(self, text: str) -> tuple[int | Span, ...]:
        """Spaces, then the part of a word; either may be missing."""
        rest = text.lstrip(" ")
        return (*([len(text) - len(rest)] if len(rest) < len(text) else []), *([self.span(rest)] if rest else []))

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The map of a chunk, from itself alone."""
        first = self.turn(chunk, 1)
        if first < 0:
            return ChunkMap(self.steps(chunk), False, 0, OUTSIDE)
        last = len(chunk)
        while True:
            last = chunk.rfind(" ", 0, last)
            if chunk[last - 1] != " ":
                break
        out, n = self.follow(OUTSIDE, self.steps(chunk[last:]))
        return ChunkMap(self.steps(chunk[:first]), True, self.spaced(chunk[first:last]) + n, out)

    @staticmethod
    def turn(chunk: str, at: int) -> int:
        """The first place from ``at`` on where a run of spaces begins, or -1."""
        while (i := chunk.find(" ", at)) >= 0:
            if chunk[i - 1] != " ":
                return i
            at = i + 1
        return -1

    def apply(self, m: ChunkMap, state: State) -> tuple[State, int]:
        """The state after a chunk, and the tokens emitted in it."""
        state, n = self.follow(state, m.head)
        if not m.settled:
            return state, n
        return m.out, n + self.ended(*state) + m.count

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``; associative."""
        if a.settled:
            out, n = self.apply(b, a.out)
            return ChunkMap(a.head, True, a.count + n, out)
        return ChunkMap(a.head + b.head, b.settled, b.count, b.out)

    def scan(self, maps: list[ChunkMap], state: State = OUTSIDE) -> list[tuple[State, int]]:
        """The state and the count before each chunk, and after the last, in two passes over a tree of compositions."""
        levels = [maps]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([self.compose(*below[i : i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
        before = [(state, 0)]
        for below in reversed(levels[:-1]):
            down = []
            for i, m in enumerate(below):
                if i % 2 == 0:
                    down.append(before[i // 2])
                else:
                    came, n = down[-1]
                    out, k = self.apply(below[i - 1], came)
                    down.append((out, n + k))
            before = down
        last, n = self.apply(maps[-1], before[-1][0])
        return [*before, (last, before[-1][1] + n)]

    def prefix_counts(self, text: str, chunk: int = CHUNK) -> list[int]:
        """Tokens of the text up to the end of each of its chunks, the last of which is the whole text."""
        if not text:
            return [0]
        spaced = " " + text.replace(SPACE, " ")
        if len(spaced) <= chunk:
            return [self.spaced(spaced)]
        after = self.scan([self.chunk_map(spaced[i : i + chunk]) for i in range(0, len(spaced), chunk)])[1:]
        return [n + self.finish(state) for state, n in after]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return self.prefix_counts(text, chunk)[-1]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text, however long (null and empty: 0).

    A column of that name is replaced, others stay; repeated rows are counted alike; an empty table stays one.
    """
    ship_package(docs.sparkSession)
    kept = without(docs, out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n = [c.count(t) if t else 0 for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


def op8(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    narrow = docs.select("doc_id", "text", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return count_tokens(narrow, model).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
