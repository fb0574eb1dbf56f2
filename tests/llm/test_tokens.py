import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow as pa
import pytest
from helpers import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinspark.llm import piece_bpe, simple8b, token_count, token_output

PARTS = ["a", "b", " ", "  ", "▁", "é", "1", "00", "\n", "\t", "the", "ing", "日本", "ж", "🙂", "</s>", "<0x0A>", "'", "'s", ".", "...,", "   ", "A", "ẞ", "́", "\x1c", "\xa0", "İ", "Σ", "<|endoftext|>"]


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces(piece_model):
    import sentencepiece

    return piece_bpe.PieceCodec(piece_model), sentencepiece.SentencePieceProcessor(model_file=piece_model)


def test_encoding_equals_the_library(pieces, edge_texts):
    codec, lib = pieces
    for t in [*random_texts(3000, 1), *(x or "" for x in edge_texts), *(" " * k + "a" for k in range(40)), "ab" * 5000]:
        ids = lib.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == lib.decode(ids) == codec.decode_parts(codec.parts(t))


def test_backtracking_alone_equals_merging(pieces):
    model = pieces[0].model
    r = random.Random(5)
    for _ in range(500):
        w = "▁" + "".join(r.choice("abcdefghint") for _ in range(r.randint(1, 12)))
        assert model.walk(w) == model.merge(w)


def test_op1(spark, piece_model, pieces, edge_texts):
    lib = pieces[1]
    got = {r.doc_id: tuple(r)[1:] for r in piece_bpe.op1(documents(spark, edge_texts), piece_model).collect()}
    for i, t in enumerate(edge_texts):
        ids = lib.encode(t or "")
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())


def test_encode_keeps_other_columns_and_replaces_clashing_ones(spark, piece_model):
    docs = documents(spark, ["hello there"]).withColumns({"IDS": F.lit("x"), "other": F.lit(7)})
    out = piece_bpe.encode_decode(docs, piece_model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "other", "ids", "decoded"]
    row = out.first()
    assert row.decoded == "hello there" and row.other == 7
    assert piece_bpe.encode_decode(docs.limit(0), piece_model).count() == 0


def test_counts_equal_the_library_for_every_chunk_size(pieces, piece_model, edge_texts):
    counter, lib = token_count.TokenCounter(piece_model), pieces[1]
    for t in [*random_texts(1500, 2), *(x or "" for x in edge_texts)]:
        want = len(lib.encode(t))
        assert {counter.count(t, c) for c in ((1, 2, 3, 7) if len(t) < 100 else (1000, 4096)) + (1 << 14,)} == {want}


def test_chunk_maps_compose_in_any_order(piece_model, pieces):
    counter, lib = token_count.TokenCounter(piece_model), pieces[1]
    r = random.Random(9)

    def total(m):
        state, n = counter.apply(m, token_count.OUTSIDE)
        return n + counter.finish(state)

    for t in random_texts(300, 3):
        if not t:
            continue
        chunks = list(" " + t.replace("▁", " "))
        maps = [counter.chunk_map(c) for c in chunks]
        after = [n + counter.finish(state) for state, n in counter.scan(maps)[1:]]
        assert after[-1] == len(lib.encode(t))
        while len(maps) > 1:
            i = r.randrange(len(maps) - 1)
            maps[i : i + 2] = [counter.compose(maps[i], maps[i + 1])]
        assert total(maps[0]) == len(lib.encode(t))


def test_prefix_counts_equal_the_library(piece_model, pieces):
    counter, lib = token_count.TokenCounter(piece_model), pieces[1]
    for t in random_texts(200, 17):
        got = counter.prefix_counts(t, 3)
        spaced = " " + t.replace("▁", " ")
        if len(spaced) > 3:
            assert got == [len(lib.encode(t[: i + 2])) for i in range(0, len(spaced) - 3, 3)] + [len(lib.encode(t))]


def test_texts_without_spaces_are_bounded(piece_model, pieces, monkeypatch):
    monkeypatch.setattr(token_count, "KEPT_STATES", 500)
    counter, lib = token_count.TokenCounter(piece_model), pieces[1]
    r = random.Random(18)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "日本語ab", "aab"):
        t = "".join(r.choice(letters) for _ in range(20_000))
        for chunk in (50, 700, 16_384, 1 << 20):
            assert counter.count(t, chunk) == len(lib.encode(t))
        assert len(counter.machine.open) <= 502


def test_op8(spark, piece_model, pieces, edge_texts):
    got = {r.doc_id: tuple(r)[1:] for r in token_count.op8(documents(spark, edge_texts), piece_model).collect()}
    for i, t in enumerate(edge_texts):
        n = len(pieces[1].encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096)


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=3000), st.integers(0, 400))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids, zeros):
    a = np.array([*ids, *([0] * zeros), *ids], dtype=np.uint64)
    coded = simple8b.from_bytes(simple8b.to_bytes(simple8b.encode(a)))
    assert (simple8b.decode(coded) == a).all()
    assert (simple8b.decode(coded, 1) == a[simple8b.BLOCK :]).all()


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(1024, dtype=np.uint64)).words) == 8
    assert len(simple8b.encode(np.full(1024, 30_000, dtype=np.uint64)).words) == 256


def test_words_equal_the_library(word_model, edge_texts):
    t = token_output.WordTokenizer(word_model)
    r = random.Random(14)
    marked = [" ".join(r.choice(["abc", "Abc'", "it's", "don't.", "a.b", "x...", "...y", "'s", "'sword", "3.5", "a_b", "_a", "ÀÉ,", "straße!?", "²m", "ªº", "1st", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|b", "\xa0", "\x85", "\x00", "\t\n", "\xad-"]) for _ in range(9)) for _ in range(3000)]
    texts = [*random_texts(3000, 4), *marked, *(x or "" for x in edge_texts)]
    want = [x.tolist() for x in t.whole(texts)]
    assert [x.tolist() for x in t.encode(pa.array(texts))] == want
    small = token_output.WordTokenizer(word_model)
    small_steps = [x.tolist() for lo in range(0, len(texts), 50) for x in small.encode(pa.array(texts).slice(lo, 50))]
    assert small_steps == want and t.encode(pa.array([None, ""]))[0].size == 0


def test_steps_cover_all_texts(monkeypatch):
    monkeypatch.setattr(token_output, "STEP_BYTES", 10)
    texts = pa.array(["", None, "abc", "x" * 30, "", "abcde", "fghij", "k"])
    assert list(token_output.steps(texts)) == [(0, 3), (3, 4), (4, 7), (7, 8)]
    assert list(token_output.steps(pa.array([], pa.string()))) == []


def test_a_small_table_of_words_changes_nothing(word_model, monkeypatch):
    monkeypatch.setattr(token_output, "KEPT_WORDS", 5)
    t = token_output.WordTokenizer(word_model)
    r = random.Random(15)
    for _ in range(60):
        texts = [" ".join(r.choice("abcdefghijkl") * r.randint(1, 3) for _ in range(8)) for _ in range(3)]
        assert [x.tolist() for x in t.encode(pa.array(texts))] == [x.tolist() for x in t.whole(texts)]


def test_op7_reads_back_what_the_library_gives(spark, word_model, edge_texts):
    lib = token_output.WordTokenizer(word_model).lib
    rows = list(reversed(list(enumerate(edge_texts))))
    got = {r.doc_id: tuple(r)[1:] for r in token_output.op7(spark, documents(spark, rows), word_model).collect()}
    start = 0
    for i, t in enumerate(edge_texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert token_output.op7(spark, documents(spark, edge_texts).limit(0), word_model).count() == 0


def test_repeated_rows_null_and_other_keys(spark, word_model):
    got = sorted((tuple(r)[:3] for r in token_output.op7(spark, documents(spark, [(None, "a"), (5, "b b"), (5, "b b"), (5, None)]), word_model).collect()), key=str)
    assert sorted(n for *_, n in got) == [1, 2, 3, 3] and sorted(s for _, s, _ in got)[0] == 0
    assert [s for k, s, _ in got if k is None] == [0]
    with pytest.raises(ValueError):
        token_output.segments(documents(spark, ["a"]).withColumn("doc_id", F.lit("x")), word_model)


def test_kept_words_are_bounded_and_change_nothing(monkeypatch):
    """Tables of half the bound each, and the half before: common words stay, ids are the library's all the same."""
    import public_tokenizers
    import sentencepiece

    from clinspark.llm import piece_bpe

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 20)
    monkeypatch.setattr(piece_bpe, "KEPT_PAIRS", 20)
    c = piece_bpe.PieceCodec(path)
    for i in range(60):
        text = f"the common word{i} of Zürich{i}  and x{i * i} unbelievable{i}"
        assert c.encode(text) == lib.encode(text)
        assert c.decode_parts(c.parts(text)) == lib.decode(lib.encode(text))
        for kept in ((c.words, c.words.old), (c.texts, c.texts.old), (c.model.pairs, c.model.old_pairs)):
            assert all(len(x) <= 10 for x in kept)


def test_words_are_encoded_by_the_stretches_that_no_piece_crosses(piece_model):
    """Words that differ only in the marks and digits around them are walked through once; ids and texts are the library's."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    c = piece_bpe.PieceCodec(piece_model)
    walked, encode = [], c.texts.encode
    c.texts.encode = lambda t: walked.append(t) or encode(t)
    words = ["unbelievably", "Zürich", "наука", "½х", "don't", "x²", "日本", "été", "№5", "a​b"]
    texts = [" ".join(a + w + b for w in words) for a in ("", "(", "\"", "7", "«", "\n", "\r\n", "▁") for b in ("", ".", "?!", "42", ",\n\nSo", "\t", "…", "🎉")]
    texts += ["", " ", "  ", "▁", " a", "a ", "a  b", "²", "².²", "\x00", "a" * 500, "-" * 500, "7" * 50]
    assert [c.encode(t) for t in texts] == [lib.encode(t) for t in texts]
    assert c.decode_all([b"".join(c.parts(t)) for t in texts]) == [lib.decode(lib.encode(t)) for t in texts]
    assert len(walked) < 150  # of over 600 different words
    assert list(piece_bpe.steps(pa.array(["a" * 200_000, None, "b" * 70_000, "", "c"]))) == [(0, 2), (2, 5)] and list(piece_bpe.steps(pa.array([], pa.string()))) == []
