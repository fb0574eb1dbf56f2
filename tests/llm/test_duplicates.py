import random

from helpers import components, documents, shingles, simhash
from oracle import assert_same
from pyspark.sql import functions as F

from clinspark.llm import line_dedup, near_dedup
from clinspark.llm import components as C
from clinspark.llm import simhash as S
from clinspark.llm.queries import oracle_sql, queries

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_op6_equals_brute_force(spark, edge_texts):
    r = random.Random(2)
    base = " ".join(r.choice("abcdefgh") * 3 for _ in range(400))
    texts = [*edge_texts, base, base.upper(), base + " tail", base.replace("aaa", "aab", 1), base[:600]]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in S.op6(spark, documents(spark, texts)).collect()}
    f = {i: simhash(t) for i, t in enumerate(texts)}
    near = [(a, b) for a in f for b in f if a < b and (f[a] ^ f[b]).bit_count() <= 4]
    want = components(f, near)
    assert got == {i: (f"{f[i]:016x}", want[i]) for i in f}
    assert S.op6(spark, documents(spark, texts).limit(0)).count() == 0


def test_null_keys_and_repeated_rows(spark):
    got = S.classes(spark, documents(spark, [(None, "one two three"), (5, "one two three"), (5, "one two three"), (None, "four")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


def test_keys_of_any_type_and_clashing_columns(spark):
    docs = documents(spark, [(1, "one two three"), (2, "one two three"), (3, "x " * 50_000)]).withColumns({"key": F.lit(0), "fingerprint": F.lit("x"), "text_hash": F.lit(1), "doc_id": F.concat(F.lit("k"), "doc_id")})
    assert {r.doc_id: r.component_id for r in S.classes(spark, docs).collect()} == {"k1": "k1", "k2": "k1", "k3": "k3"}


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(4)
    base = r.getrandbits(64)
    values = {base}
    while len(values) < 300:
        values.add((base ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 9))})) & MASK)
    tree = S.BKTree()
    for v in values:
        tree.add(v)
    for q in [*list(values)[:50], r.getrandbits(64)]:
        assert {tree.values[i] for i in tree.within(q, 4)} == {v for v in values if (v ^ q).bit_count() <= 4}


def test_links_of_a_dense_group_in_split_shards(spark):
    r = random.Random(6)
    base = r.getrandbits(64)
    values = {(base ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 5))})) & MASK for _ in range(1200)} | {r.getrandbits(64) for _ in range(800)}
    rows = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    found = [(e.src & MASK, e.dst & MASK) for e in S.links(spark, rows, 4, max_shard=150).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    listed = sorted(values)
    want = components(values, [(a, b) for i, a in enumerate(listed) for b in listed[:i] if (a ^ b).bit_count() <= 4])
    assert components(values, found) == want


def test_every_choice_of_blocks_is_exact():
    for n in (10, 10**6, 10**9, 10**12):
        blocks, agree = S.plan_blocks(n, 4)
        assert blocks - 4 == agree


def test_components_equal_union_find(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(7000, 7000)]
    rows = spark.createDataFrame([*edges, (None, 4), (4, None)], "src long, dst long")
    got = {x.node: x.component for x in C.connected_components(spark, rows).collect()}
    nodes = {n for e in edges for n in e}
    assert got == components(nodes, edges)


def test_op3_equals_its_sql(spark, tiny):
    assert_same(queries()["op3_line_dedup"](spark, tiny), oracle_sql()["op3_line_dedup"], tiny)


def test_spread_lines_go_and_copies_stay(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(60)
    own = [f"{line(40)}\n{line(9)}" for _ in range(12)]
    carriers = [f"{t}\n  {passage} \nlast {i}" for i, t in enumerate(own)]  # more than half of each is the passage
    copies = ["a copied document of one line\nand of another line"] * 10
    base = [line(30) for _ in range(6)]
    near = ["\n".join([*base[:k], base[k].replace(base[k].split()[15], word()), *base[k + 1 :]]) for k in range(6)]
    texts = [*carriers, *copies, *near, None, "", "short", "short", "One\n\nTwo"]
    docs = documents(spark, texts, [f"s{i % 10}" for i in range(len(texts))]).withColumn("N_Removed", F.lit(1))
    for lines in (line_dedup.SET_LINES, 0):  # judged in place, and by a join
        monkeypatch.setattr(line_dedup, "SET_LINES", lines)
        got = {r.doc_id: (r.text, r.n_removed, r.is_copy) for r in line_dedup.remove_boilerplate(spark, docs).collect()}
        for i, t in enumerate(carriers):
            assert got[i] == (f"{own[i]}\nlast {i}", 1, False)
        assert all(got[12 + i] == (copies[0], 0, True) for i in range(10))
        assert all(got[22 + i] == (near[i], 0, True) for i in range(6))
        assert [got[i][:2] for i in range(28, 33)] == [(None, 0), ("", 0), ("short", 0), ("short", 0), ("One\n\nTwo", 0)]
    assert line_dedup.remove_boilerplate(spark, documents(spark, ["a"]).limit(0)).count() == 0


def test_boilerplate_of_short_and_very_long_texts(spark):
    line = "all rights reserved by whoever it was that wrote this"
    rows = [(i, f"own words {i}\n{line}") for i in range(9)] + [(20, f"{line}\n" + "\n".join(f"line number {j} of a long text" for j in range(30_000)))]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(spark, documents(spark, rows, [f"s{i}" for i in range(10)])).collect()}
    assert [got[i].text for i in range(9)] == [f"own words {i}" for i in range(9)]
    assert got[20].n_removed == 1 and len(got[20].text) == len(rows[-1][1]) - len(line) - 1
    none = documents(spark, [(None, "x y z"), (None, "x y z"), (1, None)]).withColumn("source", F.lit(None).cast("string"))
    assert sorted(r.n_removed for r in line_dedup.remove_boilerplate(spark, none).collect()) == [0, 0, 0]


def near_texts(r, originals, copies, edits, length=300):
    """Texts with groups of copies of which up to so many words are replaced."""
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = []
    for i in range(originals):
        w = [r.choice(vocabulary) for _ in range(length)]
        texts.append(" ".join(w))
        for _ in range(copies if i % 2 else 0):
            v = list(w)
            for at in r.sample(range(length), r.randint(0, edits)):
                v[at] = r.choice(vocabulary)
            texts.append(" ".join(v))
    r.shuffle(texts)
    return texts


def exact_classes(texts, width=5, least=0.8):
    s = [set(shingles(t, width)) for t in texts]
    alike = lambda a, b: len(a & b) >= least * (len(a) * len(b)) ** 0.5
    return components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if alike(s[i], s[j])])


def test_near_classes_equal_brute_force(spark):
    texts = near_texts(random.Random(3), 30, 8, 24)
    want = exact_classes(texts)
    for options in ({}, {"max_block": 4, "max_shard": 5}):
        got = {x.doc_id: x.class_id for x in near_dedup.classes(spark, documents(spark, texts), **options).collect()}
        assert got == want
    kept = {x.doc_id for x in near_dedup.deduplicate(spark, documents(spark, texts)).collect()}
    assert kept == set(want.values()) and 30 <= len(kept) < len(texts)


def test_a_large_class_is_held_against_one_member(spark):
    texts = near_texts(random.Random(5), 2, 150, 16)
    want = exact_classes(texts)
    got = {x.doc_id: x.class_id for x in near_dedup.classes(spark, documents(spark, texts), max_block=20, max_shard=40).collect()}
    assert got == want


def test_repeated_lines_do_not_make_copies(spark):
    line = "this one line is said again and again in many texts. "
    texts = [line * 200 + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(4)]
    assert near_dedup.deduplicate(spark, documents(spark, texts)).count() == 4


def test_rows_go_by_key_and_text(spark):
    rows = [(3, "one text that is here"), (7, "one text that is here"), (7, "some other text altogether"), (7, "some other text altogether"), (9, "a third text"), (None, "a third text")]
    kept = near_dedup.deduplicate(spark, documents(spark, rows).withColumn("__text", F.lit(1)).withColumnRenamed("lang", "class_id"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "one text that is here"), (7, "some other text altogether"), (9, "a third text"), (None, "a third text")], key=str)
    named = documents(spark, rows[:4]).withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert sorted(r.doc_id for r in near_dedup.deduplicate(spark, named).collect()) == ["k3", "k7"]


def test_near_dedup_of_odd_rows(spark, edge_texts):
    rows = [*enumerate(edge_texts), (11, "same text here"), (None, "same text here")]
    kept = near_dedup.deduplicate(spark, documents(spark, rows))
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [0, 4, 5, 6, 7, 8, 9, 10, 11, 14, 15, None]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert near_dedup.deduplicate(spark, documents(spark, ["a"]).limit(0)).count() == 0


def test_split_shards_lose_no_link(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta iota kappa " * 30 + f"end {i}" for i in range(60)]
    assert near_dedup.deduplicate(spark, documents(spark, texts), max_shard=7).count() == 1


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    """A table of a few rows over many parts isn't a file for each row; rows and components stay the same."""
    from clinspark.llm import components

    files = []

    def count(session, df, name, **more):
        out, path = written(session, df, name, **more)
        files.append(len(out.inputFiles()))
        return out, path

    from clinspark.llm.common import written

    monkeypatch.setattr(components, "written", count)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(300).selectExpr("id AS src", "IF(id % 3 = 2, id, id + 1) AS dst")
        got = {r.node: r.component for r in components.connected_components(spark, edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - i % 3 for i in range(300)}
    assert files and max(files) <= max(4 * spark.sparkContext.defaultParallelism, 13)
