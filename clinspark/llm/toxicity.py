"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read into classes: insult (learned, weighted), threat, target, negation and reported speech (closed lists in four
languages). Each class has a transducer of its own, built apart: those of target, negation and reported speech mark the
words that they reach; that of threats joins a threat with a target before or after it; that of insults turns a hit with
its marks into a pattern (plain, at a target, negated, reported). :func:`compose` chains them, the output of one being the
input of the next, and :func:`compiled` gives the composition as one table of numbered states. A clause adds the weights of
its different hits under their patterns, equal clauses once; a document's score is a logistic function of these sums.

Learned from a bounded sample of labelled rows: which word forms and word beginnings (stems, so that inflected forms
match too) mark insults, which words are threats (they mark the label only where a target is near), and the weights of the
patterns, ordered by construction: a hit at a target counts most, a plain one less, a negated or reported one least. The
words of a text are all that a score depends on.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinspark.llm.common import remove, ship_package, without, written

#: Labelled rows that a fit takes at most, by the hash of their id. What is learned from them is bounded by them.
SAMPLE_ROWS = 20_000
#: Word beginnings of these lengths are tried as stems.
STEMS = range(3, 11)
KEPT_WORDS = 150_000
WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]")

# Closed classes of words in English, German, French and Spanish.
TARGETS = frozenset("you your yours yourself u ya he she they him her them his their du dich dir dein deine ihr euch euer sie tu toi te ton ta vous votre vos tú ti usted ustedes vosotros tus él ella ellos".split())
NEGATIONS = frozenset("not no never nobody isn aren wasn don doesn didn nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna tampoco".split())
REPORTS = frozenset("said says say called calls told tells wrote writes quoted quote claims claimed accused sagte sagt nannte nennt schrieb zitierte dit disait appelle appelait écrit dijo dice llamó llama escribió".split())
THREATS = frozenset("kill hurt destroy beat stab shoot murder burn töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split())
#: How many words a target, a negation or a reporting verb reaches, and a threat its target.
REACH = {"target": 4, "negation": 3, "report": 6, "threat": 3}
PATTERNS = ("plain", "target", "negated", "reported")
KINDS = ("hit", "threat", "target", "negation", "report", "end", "other")
NONE = -1
#: By how much of a hit's weight a plain one goes over a negated one, and one at a target over a plain one, at the least.
STEP = 0.1


class Symbol(NamedTuple):
    """What the transducers read and write: a word's class, its marks, and the pattern that it completes."""

    kind: str
    target: bool = False
    negation: bool = False
    report: bool = False
    pattern: int = NONE


class Machine(NamedTuple):
    """A deterministic transducer: its first state, and what a state and a symbol lead to and write."""

    start: Hashable
    step: Callable[[Hashable, Symbol], tuple[Hashable, Symbol]]


def marker(kind: str) -> Machine:
    """Marks the words that a word of this kind reaches. The state: how many words more."""

    def step(left: int, x: Symbol) -> tuple[int, Symbol]:
        out = x._replace(**{kind: left > 0})
        return REACH[kind] if x.kind == kind else 0 if x.kind == "end" else max(0, left - 1), out

    return Machine(0, step)


def pattern_of(x: Symbol) -> int:
    return 3 if x.report else 2 if x.negation else 1 if x.target else 0


def threats() -> Machine:
    """A threat at a target that came before it, or comes within reach after. The state: how long a threat still waits."""

    def step(left: int, x: Symbol) -> tuple[int, Symbol]:
        if x.kind == "end":
            return 0, x
        if x.kind == "threat":
            at = pattern_of(x)
            return (0, x._replace(pattern=1)) if at == 1 else (REACH["threat"] if at == 0 else 0, x)
        if x.kind == "target" and left:
            return 0, x._replace(pattern=1)
        return max(0, left - 1), x

    return Machine(0, step)


def insults() -> Machine:
    """A hit under the pattern that its marks show; it needs no state."""
    return Machine(0, lambda s, x: (s, x._replace(pattern=pattern_of(x)) if x.kind == "hit" else x))


def compose(a: Machine, b: Machine) -> Machine:
    """``b`` reads what ``a`` writes; associative."""

    def step(state: tuple, x: Symbol) -> tuple[tuple, Symbol]:
        left, y = a.step(state[0], x)
        right, z = b.step(state[1], y)
        return (left, right), z

    return Machine((a.start, b.start), step)


@lru_cache(maxsize=1)
def compiled() -> tuple[list[dict[str, int]], list[dict[str, int]]]:
    """The composition of the five as tables: next state and pattern for each numbered state (0 first) and class."""
    m = reduce(compose, (marker("target"), marker("negation"), marker("report"), threats(), insults()))
    number, to, out = {m.start: 0}, [], []
    states = [m.start]
    for state in states:
        to.append({})
        out.append({})
        for kind in KINDS:
            new, y = m.step(state, Symbol(kind))
            if new not in number:
                number[new] = len(states)
                states.append(new)
            to[-1][kind] = number[new]
            out[-1][kind] = y.pattern
    return to, out


class Hit(NamedTuple):
    pattern: int
    weight: float
    word: str


#: The patterns that each number of :meth:`Grammar.features` sums over: all, those without negation or report, at a target.
SUMMED = ((0, 1, 2, 3), (0, 1), (1,))
FEATURES = len(SUMMED)


class Grammar:
    """The composed machine with a lexicon of weighted words, stems and threats (if not given: the seeds, of weight 1)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: dict[str, float] | None = None):
        self.words, self.stems = words, stems
        self.threats = dict.fromkeys(sorted(THREATS), 1.0) if threats is None else threats
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self.known: dict[str, tuple[str, float] | None] = {}
        self.to, self.out = compiled()
        self.rest = max(REACH.values())

    def kind(self, word: str) -> tuple[str, float] | None:
        """The class of a lower-case word and its weight; an accepted stem is the longest that the word begins with."""
        try:
            return self.known[word]
        except KeyError:
            pass
        w = self.words.get(word)
        if w is None:
            for n in self.lengths:
                if n <= len(word) and (w := self.stems.get(word[:n])) is not None:
                    break
        if w is not None:
            k = ("hit", w)
        elif word in self.threats:
            k = ("threat", self.threats[word])
        elif word in TARGETS:
            k = ("target", 0.0)
        elif word in NEGATIONS:
            k = ("negation", 0.0)
        elif word in REPORTS:
            k = ("report", 0.0)
        elif len(word) == 1 and word in ".!?;:\n":
            k = ("end", 0.0)
        else:
            k = None
        if len(self.known) >= KEPT_WORDS:
            self.known.clear()
        if len(word) <= 100:
            self.known[word] = k
        return k

    def clauses(self, text: str) -> Iterator[list[Hit]]:
        """The hits of each clause that has any; a threat counts where it has a target."""
        tokens = WORD.findall(text.lower())
        kind, known = self.kind, self.known
        kinds = [known[t] if t in known else kind(t) for t in tokens]
        if not any(k is not None and k[0] in ("hit", "threat") for k in set(kinds)):
            return
        to, out, rest = self.to, self.out, self.rest
        state, hits, idle = 0, [], 0
        threat = ("", 0.0)  # the last one: the only one that can wait for a target
        for word, k in zip(tokens, kinds, strict=True):
            if k is None:
                idle += 1
                continue
            for _ in range(min(idle, rest)):  # by then nothing reaches any more
                state = to[state]["other"]
            idle = 0
            pattern, state = out[state][k[0]], to[state][k[0]]
            if k[0] == "threat":
                threat = (word, k[1])
            if pattern != NONE:
                w, weight = (word, k[1]) if k[0] == "hit" else threat
                hits.append(Hit(pattern, weight, w))
            elif k[0] == "end" and hits:
                yield hits
                hits = []
        if hits:
            yield hits

    def features(self, text: str) -> list[float]:
        """What a score depends on: for each entry of ``SUMMED`` the damped sum over the matched clauses.

        A clause adds the weight of each different word that it matched, under that word's last pattern there; a clause
        that repeats another's matches adds nothing.
        """
        seen: set[frozenset[Hit]] = set()
        sums = [0.0] * len(PATTERNS)
        for hits in self.clauses(text):
            clause = frozenset({h.word: h for h in hits}.values())
            if clause not in seen:
                seen.add(clause)
                for h in sorted(clause):
                    sums[h.pattern] += h.weight
        return [math.log1p(sum(sums[p] for p in over)) for over in SUMMED]


def stems_of(word: str) -> Iterator[str]:
    for n in STEMS:
        if n < len(word):
            yield word[:n] + "*"
    yield word


def aimed(tokens: list[str]) -> Iterator[tuple[str, str]]:
    """Words with a target within a threat's reach in their clause, each as ``@word``, with the word before."""
    last, before, near = None, "", []  # the last target's place; the places after it that still wait for one
    for i, w in enumerate(tokens):
        if w in ".!?;:\n":
            last, near = None, []
        elif w in TARGETS:
            yield from (("@" + x, y) for j, x, y in near if i - j <= REACH["threat"])
            last, near = i, []
        elif last is not None and i - last <= REACH["target"]:
            yield "@" + w, before
        else:
            near = [*near[-REACH["threat"] :], (i, w, before)]
        before = w


def count_forms(labelled: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """form, pos, neg: in how many texts of either label a word, a stem (with ``*``) or an aimed word (``@``) occurs."""
    ship_package(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            forms = list(counts[1].keys() | counts[0].keys())
            out = pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), *(pa.array([counts[y][f] for f in forms], pa.int64()) for y in (1, 0))], names=["form", "pos", "neg"])
            counts[0].clear()
            counts[1].clear()
            return out

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forms: set[str] = set()
                tokens = WORD.findall((t or "").lower())
                for w in set(tokens):
                    forms.update(stems_of(w))
                forms.update(f for f, _ in aimed(tokens))
                counts[1 if y else 0].update(forms)
                if len(counts[0]) + len(counts[1]) > 500_000:
                    yield flush()
        yield flush()

    return labelled.select(text, label).mapInArrow(run, "form string, pos long, neg long").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def count_contexts(labelled: DataFrame, forms: list[str], text: str = "text") -> DataFrame:
    """form, contexts: after how many different words each of the given forms occurs."""
    given = frozenset(forms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for t in batch.column(0).to_pylist():
                before, tokens = "", WORD.findall((t or "").lower())
                for w in tokens:
                    found.update((f, before) for f in stems_of(w) if f in given)
                    before = w
                found.update(x for x in aimed(tokens) if x[0] in given)
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["form", "before"])

    return labelled.select(text).mapInArrow(run, "form string, before string").groupBy("form").agg(F.count_distinct("before").alias("contexts"))


class Lexicon(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    threats: dict[str, float]


def learn_lexicon(rows: DataFrame, positives: int, negatives: int) -> Lexicon:
    """Words, stems and threats that mark the label, with their log-odds, if too strong for chance.

    The strong forms are collected: no more than the sample, which bounds them, has. Copies of one text are no further evidence: a form must follow many different words. A stem must be productive,
    that is, no single word may make up most of it; it is as long as its coverage allows. A threat marks the label near a
    target and is no insult by itself. Of the seeds, those that occur at targets take their log-odds there (none below 0),
    the others the median weight of what was learned.
    """
    p = positives / (positives + negatives)
    n = F.col("pos") + F.col("neg")
    odds = F.log((F.col("pos") + 0.5) / (positives + 1.0)) - F.log((F.col("neg") + 0.5) / (negatives + 1.0))
    seeds = ["@" + w for w in sorted(THREATS)]
    counted = count_forms(rows).withColumns({"odds": odds, "precision": F.col("pos") / n})
    found = counted.where(((F.col("pos") >= 4) & (F.col("odds") > 1.5)) | (F.col("form").isin(seeds) & (n >= 4))).collect()
    seeded = {r["form"][1:]: max(0.0, float(r["odds"])) for r in found if r["form"] in seeds}
    top = sorted((r for r in found if r["pos"] >= 4 and r["odds"] > 1.5), key=lambda r: (-r["pos"], -r["odds"], r["form"]))
    contexts = {r["form"]: r["contexts"] for r in count_contexts(rows.where("label = 1"), [r["form"] for r in top]).collect()}

    def evident(r) -> bool:
        k = min(contexts.get(r["form"], 0), r["pos"])
        share = max(r["precision"], p)
        gain = share * math.log(share / p) + ((1 - share) * math.log((1 - share) / (1 - p)) if share < 1 else 0.0)
        return k >= 4 and k >= 0.3 * r["pos"] and k / share * gain > 8

    shown = [r for r in top if evident(r)]
    kept = {r["form"]: (r["pos"], r["odds"]) for r in shown if not r["form"].startswith("@")}
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for form in kept:
        body = form.rstrip("*")
        for k in range(STEMS.start, len(body) + (not form.endswith("*"))):
            longer.setdefault(body[:k] + "*", []).append(form)

    def covered(body: str) -> bool:
        return body in words or any(body[:k] in stems for k in STEMS if k <= len(body))

    for form, (pos, o) in kept.items():  # in descending order of pos
        while form.endswith("*"):
            near = [f for f in longer.get(form, ()) if kept[f][0] >= (0.9 if f.endswith("*") else 0.6) * pos and kept[f][1] >= o - 0.5]
            if not near:
                break
            form = max(near, key=lambda f: (not f.endswith("*"), -len(f), kept[f][0]))
            pos, o = kept[form]
        if covered(form.rstrip("*")):
            continue
        if form.endswith("*"):
            stems[form[:-1]] = float(o)
        elif form.isalpha():
            words[form] = float(o)
    threats = {r["form"][1:]: float(r["odds"]) for r in shown if r["form"].startswith("@")}
    learned = sorted([*words.values(), *stems.values(), *threats.values()])
    if learned:
        threats = dict.fromkeys(sorted(THREATS), learned[len(learned) // 2]) | threats | seeded
    return Lexicon(words, stems, {w: o for w, o in threats.items() if o > 0 and not covered(w)})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights (intercept last) by Newton's method with a ridge; balanced classes, so 0.5 lies between them.

    No weight is negative, and each but the first is at least ``STEP`` of the first: what is in more sums counts more.
    """
    z = np.column_stack([x[:, 0] + STEP * x[:, 1:].sum(axis=1), x[:, 1:], np.ones(len(x))])
    w = np.zeros(z.shape[1])
    n1 = max(y.sum(), 1)
    n0 = max(len(y) - y.sum(), 1)
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        free = (w > 0) | (g < 0)  # a weight at 0 that would fall stays there
        free[-1] = True
        new = w.copy()
        new[free] -= np.linalg.solve(h[np.ix_(free, free)], g[free])
        new[:-1] = np.maximum(new[:-1], 0.0)
        moved, w = np.abs(new - w).max(), new
        if moved < 1e-8:
            break
    return np.concatenate([w[:1], w[1:-1] + STEP * w[0], w[-1:]])


def _featured(docs: DataFrame, model: str, text: str, out: str, score: bool) -> DataFrame:
    kept = without(docs, out)
    kind = T.DoubleType() if score else T.ArrayType(T.DoubleType(), False)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                x = [m.grammar.features(t or "") for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                col = pa.array(m.score(x)) if score else pa.array(x, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


class Toxicity:
    """A fitted model; ``to_json`` keeps all of it."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: list[float], threats: dict[str, float] | None = None):
        self.words, self.stems, self.weights = words, stems, weights
        self.grammar = Grammar(words, stems, threats)
        self.threats = self.grammar.threats

    def to_json(self) -> str:
        return json.dumps({"words": self.words, "stems": self.stems, "threats": self.threats, "weights": list(self.weights)}, sort_keys=True)

    def score(self, features: list[list[float]]) -> np.ndarray:
        w = np.array(self.weights)
        z = np.array(features, dtype=float).reshape(-1, len(w) - 1) @ w[:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score_documents(self, docs: DataFrame, text: str = "text", out: str = "toxicity") -> DataFrame:
        """``docs`` with a score from 0 to 1 for each whole text; a null text counts as empty. Replaces a column ``out``."""
        ship_package(docs.sparkSession)
        return _featured(docs, self.to_json(), text, out, True)


@lru_cache(maxsize=2)
def loaded(model: str) -> Toxicity:
    m = json.loads(model)
    return Toxicity(m["words"], m["stems"], m["weights"], m["threats"])


def fit(labelled: DataFrame, text: str = "text", label: str = "label") -> Toxicity:
    """Fit on all given rows, a bounded sample (:func:`training_rows`). Null labels are left out.

    Without rows of both labels nothing can be learned: then every score is that of a text without matches.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    rows, path = written(spark, labelled.select(F.col(text).alias("text"), (F.col(label) == 1).cast("int").alias("label")).where("label IS NOT NULL"), "labelled")
    by = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = by.get(1, 0), by.get(0, 0)
    plain = [0.0] * FEATURES
    if not pos or not neg:
        remove(spark, path)
        return Toxicity({}, {}, [*plain, -4.0], {})
    words, stems, threats = learn_lexicon(rows, pos, neg)
    if not words and not stems and not threats:  # nothing tells the labels apart: no text is toxic
        remove(spark, path)
        return Toxicity({}, {}, [*plain, -4.0], {})
    model = Toxicity(words, stems, [*plain, 0.0], threats)
    seen = _featured(rows, model.to_json(), "text", "features", False).groupBy("label", "features").agg(F.count("*").alias("n")).collect()  # no more rows than the sample
    remove(spark, path)
    x = np.repeat(np.array([r["features"] for r in seen]), [r["n"] for r in seen], axis=0)
    y = np.repeat(np.array([r["label"] for r in seen]), [r["n"] for r in seen])
    return Toxicity(words, stems, fit_logistic(x, y.astype(float)).tolist(), threats)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and label of about ``sample_rows`` labelled rows that are not held out, chosen by the hash of their id.

    Only the sampled ids, so bounded, are broadcast to the documents; no text is shuffled. A document with labels that
    contradict each other counts as toxic.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts score as texts without matches; repeated rows score alike, each with its row; other columns, of
    whatever name, are not read. Texts are scored whole.
    """
    model = fit(training_rows(docs, labels))
    out = model.score_documents(docs.select("doc_id", "text"), out="score")
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
