import numpy as np
import pytest

import corpus_pipeline
from clinspark.llm import ann
from clinspark.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int"


def truth(rows, k=20):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in fine:
        if q % 20 == 0:
            s = sorted((-float(v @ x), i) for i, x in fine if i != q and len(x) == len(v))
            out[q] = [(i, -d) for d, i in s[:k]]
    return out


def test_recall_against_brute_force(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = truth([(r.vec_id, r.embedding) for r in e.collect()])
    got = {}
    for r in ann.op4(spark, e).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and [-s for _, _, s in rows] == sorted(-s for _, _, s in rows)
    recall = np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.97


def test_ties_repeats_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, [0.0, 0.0]), (120, None), (140, []), (160, [1.0, None]), (180, [float("nan"), 1.0]), (61, [float("inf"), 1.0]), (200, [0.5, 0.5]), (201, [2.0, 1.0])]
    got = ann.op4(spark, spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).orderBy("query_id", "rank").collect()
    want = truth(rows)
    assert {r.query_id for r in got} == want.keys() == {0, 20, 40, 200}
    for q in want:
        assert [(r.vec_id, pytest.approx(r.score)) for r in got if r.query_id == q] == want[q]


def test_repeated_rows_other_lengths_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i % 50, [float(i % 7), 1.0]) for i in range(90)] + [(200, [1.0, 2.0, 3.0]), (201, [3.0, 2.0, 1.0])]
    e = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumns({"shard": F.lit("x"), "DIMS": F.lit(1), "query_id": F.lit(7)})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.op4(spark, e).collect()}
    assert got[200, 1] == (201, 10.0) and (200, 2) not in got
    assert {q for q, _ in got} == {0, 20, 40, 200} and all((q, 20) in got for q in (0, 20, 40))


def test_few_candidates(spark):
    got = ann.op4(spark, spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], VECTORS)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2.0)]
    assert ann.op4(spark, spark.createDataFrame([(0, [1.0], 0)], VECTORS)).count() == 0
    assert ann.op4(spark, spark.createDataFrame([], VECTORS)).count() == 0


def test_pruned_graphs_reach_every_node():
    x = np.random.default_rng(1).normal(size=(700, 8))
    g = ann.Graph.build(x)
    assert (g.edges < 700).all() and (g.edges >= -1).all() and not (g.edges == np.arange(700)[:, None]).any()
    seen, todo = {g.entry}, [g.entry]
    while todo:
        for n in g.edges[todo.pop()].tolist():
            if n >= 0 and n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) > 690


def test_pipeline_stage_by_stage(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        if name == "line_dedup":
            assert set(ids) == before
        if k < 4:
            assert out.columns == columns
        docs, before = out, set(ids)
    assert docs.where("NOT round_trip").count() == 0 and len(before) > 700


def test_pipeline_equals_plain_stages(spark, piece_model):
    import math

    import sentencepiece
    from helpers import components, leaks, shingles, without_boilerplate
    from test_filters import plain_features

    from clinspark.llm import toxicity

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, d, "labels")))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    def score(text):
        return sum(w * x for w, x in zip(model.weights, [*plain_features(text or "", model.words, model.stems, model.threats), 1.0], strict=True))

    clean = [r for r in rows if score(r[1]) < 0]
    texts = without_boilerplate(clean)
    sets = {i: set(shingles(t, 5)) for i, t in texts.items()}
    ids = sorted(texts)
    alike = lambda a, b: len(a & b) >= 0.8 * math.sqrt(len(a) * len(b))
    classes = components(ids, [(a, b) for a in ids for b in ids if b < a and alike(sets[a], sets[b])])
    firsts = [(i, texts[i]) for i in ids if classes[i] == i]
    dirty = {k for k, _ in leaks(firsts, [(r.item_id, r.text) for r in table(spark, d, "benchmark").collect()])}
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    want = {i: lib.encode(t or "") for i, t in firsts if i not in dirty}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert all(r.n_tokens == len(r.ids) for r in got.values()) and 0 < len(want) < len(clean) <= len(rows)


def test_pipeline_of_an_empty_table(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0
