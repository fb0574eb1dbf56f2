import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from helpers import components, documents
from pyspark.sql import functions as F

from clinspark.llm import fill_middle as M
from clinspark.llm import quantised as Q
from clinspark.llm import spelling as S
from clinspark.llm.common import table

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EMPTY = hashlib.sha256(b"").hexdigest()


# --- fill-in-the-middle ---------------------------------------------------------------------------------------------------


def plain_fim(name, text):
    text = text or ""
    units = TOKENS.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_to_cut(edge_texts):
    r = random.Random(5)
    mixed = ["".join(r.choice("ab é日 \t\n <SPM>") for _ in range(r.randint(0, 90))) for _ in range(150)]
    return [*edge_texts, *mixed, "a <P> b", "<S", "x" * 40_000 + " y", " " * 40_000, ("wort 日本 " * 9000) + "  "]


def test_op11_equals_a_plain_version(spark, edge_texts):
    rows = [*enumerate(texts_to_cut(edge_texts)), (3, "twice"), (3, "twice"), (3, "other"), (None, "no key at all"), (None, None)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(map(str, ((i, *(w := plain_fim(i, t))[:4], digest(w[4]), digest(t or "")) for i, t in rows)))
    got = M.op11(spark, documents(spark, rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert {"plain", "spm", "psm"} == {r.form for r in got.collect()}
    assert M.op11(spark, documents(spark, rows).limit(0)).count() == 0


def test_chunks_of_giants_give_the_same_cuts(spark, edge_texts):
    docs = documents(spark, texts_to_cut(edge_texts)).withColumns({"__n": F.lit(1), "FORM": F.lit("x"), "mark": F.lit(2), "data": F.lit("y")})
    one = M.fill_in_middle(spark, docs, giant=1 << 30)
    assert sorted(map(str, one.collect())) == sorted(map(str, M.fill_in_middle(spark, docs, giant=0).collect()))
    assert one.where(~M.restored(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert set(one.columns) == {*docs.columns, *M.ADDED} - {"FORM"}


def test_small_chunks_compose():
    r = random.Random(9)
    for _ in range(300):
        t = "".join(r.choice("a é日 \n") for _ in range(r.randint(0, 60)))
        data, h1, h2 = np.frombuffer(t.encode(), np.uint8), r.getrandbits(32), r.getrandbits(32)
        assert len({M.cuts(data, h1, h2, chunk) for chunk in (1, 2, 3, 7, 1000)}) == 1
        assert M.cuts(data, h1, h2)[0] == len(TOKENS.findall(t))


# --- spelling variants ----------------------------------------------------------------------------------------------------


def plain_tally(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return counts


def plain_variants(counts):
    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [v for v in counts if v != w and near(w, v)] for w in counts}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(by[w]), counts[form[w]] if form[w] else None))
    return sorted(map(str, out))


def test_op12_equals_a_plain_version(spark):
    d = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    extra = [(900, "Wörter wörter WÖRTER Straße " * 9), (901, None), (902, ""), (None, "nokeyword " * 7), (903, "nokeywordd " * 60), (904, "nokeyworddd " * 400), (905, "anagram×anagram÷ " * 30), (905, "anagram×anagram÷ " * 30), (906, "y" * 70_000 + " " + "longest " * 6)]
    rows = [tuple(r) for r in d.collect()] + extra
    counts = {w: n for w, n in plain_tally(rows).items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "shard": F.lit(0)})
    got = sorted(str(tuple(r)) for r in S.op12(spark, docs).collect())
    assert got == plain_variants(counts) and len(counts) > 300
    assert S.op12(spark, docs.limit(0)).count() == 0


def test_dense_words_in_parts_and_blocks(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(1500)} | {"preffix" + x + y for x in "abcdefgh" for y in "abcdefgh"} | {x + y + "ssuffix" for x in "abcdefgh" for y in "abcdefgh"}
    counts = {w: r.choice([1, 2, 9, 50, 400, 3000]) for w in words}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(str((x.word, x.form, x.root, x.n, x.n_near, x.form_n)) for x in S.variants(spark, rows).collect()) == plain_variants(counts)
    few = S.near_words(spark, rows, part=100, block=90).groupBy("word").count().collect()
    assert {x.word: x["count"] for x in few} == {x.word: x["count"] for x in S.near_words(spark, rows).groupBy("word").count().collect()}


def test_one_edit():
    assert all(S.one_edit(*p) for p in (("abc", "abd"), ("abc", "abcd"), ("abc", "xabc"), ("aab", "aaab")))
    assert not any(S.one_edit(*p) for p in (("abc", "abc"), ("abc", "acb"), ("abc", "abxdc"[:4]), ("abc", "bbd")))


# --- embeddings -----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_links(rows, cosine=0.95):
    fine = {k: np.array(v, dtype=float) for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {k: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for k, v in fine.items()}
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    root = components(range(len(rows)), pairs)
    n = Counter(x for p in pairs for x in p)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    return sorted(str((i, n[k], least[root[k]], i == least[root[k]])) for k, (i, _) in enumerate(rows))


def some_vectors():
    r = np.random.default_rng(8)
    seeds = r.normal(size=(12, 6))
    near = [s + r.normal(size=6) * r.choice([0.02, 0.1, 0.25]) for s in seeds for _ in range(40)]
    x = [*r.normal(size=(300, 6)), *near, *r.normal(size=(9, 3)), [1e-30, 2e-30, 1e-30], [1e30, 2e30, 1e30], [2.0, 4.0, 2.0]]
    rows = [(7 * i % 1009, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return [*rows, rows[5], rows[5], (2000, rows[5][1]), (2001, None), (2002, []), (2003, [0.0] * 6), (2004, [1.0, None, 0.0]), (2005, [float("nan")] * 6), (2006, [float("inf")] * 6), (2007, [3.0])]


def test_op13_equals_brute_force(spark):
    rows = some_vectors()
    e = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumns({"node": F.lit("x"), "least": F.lit(1), "n_links": F.lit(2), "COPIES": F.lit(3)})
    assert sorted(str(tuple(r)) for r in Q.op13(spark, e).collect()) == plain_links(rows)
    assert Q.op13(spark, e.limit(0)).count() == 0


def test_parts_blocks_and_uncoded_vectors(spark, monkeypatch):
    import functools

    rows = some_vectors()
    e = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    monkeypatch.setattr(Q, "MAX_KINDS", 1)
    monkeypatch.setattr(Q, "LIST_ROWS", 60)
    monkeypatch.setattr(Q, "search", functools.partial(Q.search, part=40, block=30))
    assert sorted(str(tuple(r)) for r in Q.op13(spark, e).collect()) == plain_links(rows)


def test_probes_and_codes_lose_no_pair():
    r = np.random.default_rng(2)
    x = Q.units(r.normal(size=(600, 16)))
    y = Q.units(x + r.normal(size=x.shape) * 0.075)
    q = Q.Quantiser(x, 20)
    reach = float(np.sqrt(0.1))
    (hx, ax), (hy, ay) = q.probes(x, reach), q.probes(y, reach)
    close = np.einsum("ij,ij->i", x, y) >= 0.95
    assert close.sum() > 200 and (ax[np.arange(600), hy] | ay[np.arange(600), hx])[close].all()
    c, e = q.codes(y, hy)
    for k in np.flatnonzero(close).tolist():
        assert q.distances(x[k : k + 1], int(hy[k]), c[k : k + 1])[0, 0] <= (reach + e[k] + Q.SLACK) ** 2
    assert ax.mean() < 0.9


def test_all_links_of_the_tables_are_found(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    assert sorted(str(tuple(r)) for r in Q.op13(spark, e).collect()) == plain_links(rows)


def test_the_sample_is_chosen_by_hash_alone(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(6000, 5)))]
    vectors = spark.createDataFrame(rows, "node long, embedding array<double>")
    found = Q.sampled(vectors.repartition(7), 5, 6000, 1000)
    assert 850 < len(found) < 1150 and np.allclose(np.linalg.norm(found, axis=1), 1)
    assert (found == Q.sampled(vectors.coalesce(1), 5, 6000, 1000)).all()
    every = {v.tobytes() for v in Q.units(np.array([v for _, v in rows]))}
    assert {v.tobytes() for v in found} <= every and {v.tobytes() for v in Q.sampled(vectors, 5, 6000, 6000)} == every
    assert len(Q.sampled(vectors.limit(1), 5, 1 << 40, 1)) == 1
