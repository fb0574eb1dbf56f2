import random
import re

import pytest
from helpers import components, documents

from clinspark.llm import decontaminate, sharding, toxicity, url_filter
from clinspark.llm.common import table
from clinspark.llm.queries import queries

QUESTION = "Once upon a time John had 15 apples and gave 7 of them to Mary before the 15 apples were sold at the market for profit"


def items(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_refilled_templates_are_caught_only_if_slots_agree(spark):
    docs = [
        QUESTION,
        "Some words before. Once upon a time Peter had 22 apples and gave 9 of them to Susan before the 22 apples were sold at the market for profit. And after",
        "once upon a time Peter had 22 apples and gave 9 of them to Susan before the 31 apples were sold at the market for profit",
        QUESTION.upper() + "!!",
        None, "", "nothing of the kind is in here at all, though it has words enough for a window",
        "had 15 apples and gave 7 of them to Mary",
    ]
    got = {(r.doc_id, r.item_id): (r.kind, r.changed_slots) for r in decontaminate.op2(spark, documents(spark, docs), items(spark, QUESTION, "too short", None)).collect()}
    assert got == {(0, 0): ("verbatim", 0), (1, 0): ("re-parameterised", 4)} | ({(3, 0): got[3, 0]} if (3, 0) in got else {})
    kept = decontaminate.decontaminate(spark, documents(spark, [*docs, (None, QUESTION)]), items(spark, QUESTION))
    assert {r.doc_id for r in kept.collect()} >= {2, 4, 5, 6, 7, None}
    assert not {r.doc_id for r in kept.collect()} & {0, 1}


def test_whole_passages_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    docs = {r.doc_id: " " + " ".join(tokens(r.text)) + " " for r in table(spark, d, "documents").collect()}
    bench = {r.item_id: " " + " ".join(tokens(r.text)) + " " for r in table(spark, d, "benchmark").collect()}
    want = {(i, j) for i, t in docs.items() for j, b in bench.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in queries()["op2_decontamination"](spark, d).collect()}
    assert want and want <= got
    assert len(got - want) <= len(want) // 20


def test_a_large_benchmark_takes_the_shuffled_way_to_the_same_rows(spark, monkeypatch):
    docs, bench = documents(spark, [QUESTION, "x " + QUESTION.replace("15", "16")]), items(spark, QUESTION)
    small = {tuple(r) for r in decontaminate.op2(spark, docs, bench).collect()}
    whole = {tuple(r) for r in queries()["op2_decontamination"](spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(decontaminate, "ANCHORS", 0)
    for anchors in (decontaminate.BROADCAST_ANCHORS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ANCHORS", anchors)
        assert {tuple(r) for r in decontaminate.op2(spark, docs, bench).collect()} == small
        assert {tuple(r) for r in queries()["op2_decontamination"](spark, "/root/testdata/sf0.001").collect()} == whole
    assert len(small) == 2 and whole


def test_empty_tables(spark):
    none = documents(spark, [QUESTION]).limit(0)
    assert decontaminate.op2(spark, none, items(spark, QUESTION)).count() == 0
    assert decontaminate.op2(spark, documents(spark, [QUESTION]), items(spark, QUESTION).limit(0)).count() == 0


# --- sharding ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 64, 101, 1000, 4097])
def test_permutation_is_one(n):
    assert sorted(sharding.permute(x, n) for x in range(n)) == list(range(n))
    assert sharding.longest_walk(n) <= n


def test_op5_is_the_law_of_rows(spark, edge_texts):
    import zlib

    rows = [(i * 7 % 101, t) for i, t in enumerate(edge_texts * 3)]
    n = len(rows)
    got = sharding.op5(spark, documents(spark, rows)).collect()
    order = sorted(rows)if all(t is not None for _, t in rows) else sorted(rows, key=lambda r: r[0])
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(order):
        r, data = by[i], (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        assert (r.shard, r.slot) == sharding.shard_of(k, n, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - n / 8) < 1
    assert sharding.op5(spark, documents(spark, ["a"]).limit(0)).count() == 0


def test_null_and_repeated_keys_are_numbered(spark):
    got = sharding.op5(spark, documents(spark, [(None, "a"), (None, "a"), (3, "x"), (3, "x"), (1, None)])).collect()
    assert len(got) == 5 and len({(r.shard, r.slot) for r in got}) == 5


def test_a_key_of_all_rows_is_split_and_clashing_columns_are_replaced(spark):
    from pyspark.sql import functions as F

    rows = [(7, f"text {i}") for i in range(500)] + [(None, f"t {i}") for i in range(300)] + [(i, "x") for i in range(100)]
    docs = documents(spark, rows).withColumns({"ROW_NUMBER": F.lit("a"), "Shard": F.lit("b"), "slot": F.lit("c")})
    out = sharding.assign(spark, docs, 8, ties=["text"])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row_number", "shard", "slot"]
    got = sorted(out.collect(), key=lambda r: r.row_number)
    assert [r.row_number for r in got] == list(range(900))
    keys = [r.doc_id for r in got]
    assert keys == [None] * 300 + sorted(k for k in keys if k is not None)
    assert {(r.shard, r.slot) for r in got} == {sharding.shard_of(i, 900, 8) for i in range(900)}


# --- toxicity ----------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scored = queries()["op9_toxicity"](spark, d).where("held_out").join(table(spark, d, "labels"), "doc_id").select("predicted", "toxic", "score").collect()
    assert len(scored) > 500 and all(0 <= r.score <= 1 for r in scored)
    right = sum(r.predicted == r.toxic for r in scored) / len(scored)
    caught = sum(r.predicted for r in scored if r.toxic) / sum(r.toxic for r in scored)
    assert right > 0.95 and caught > 0.85


def test_grammar_tells_contexts_apart():
    g = toxicity.Grammar({"zork": 5.0}, {"blarg": 4.0})
    kinds = lambda t: [toxicity.PATTERNS[h.pattern] for c in g.clauses(t) for h in c]
    assert kinds("Zork here") == ["plain"]
    assert kinds("you are a zork") == ["target"]
    assert kinds("not a zork at all") == ["negated"]
    assert kinds("they said he is a zork") == ["reported"]
    assert kinds("she said it. A zork!") == ["plain"]
    assert kinds("blargung, blargst") == ["plain", "plain"]
    assert kinds("kill the lights") == [] and kinds("you, kill") == ["target"]
    assert kinds("will kill you all") == ["target"] and kinds("not kill you") == [] and kinds("kill it. You") == []
    assert kinds("") == [] and g.features("nothing") == [0.0] * toxicity.FEATURES


def plain_features(text, lexicon, stems, threats):
    """What a score depends on, clause by clause and word by word, by looking back at the words before."""
    matched = set()
    tokens = re.findall(r"[^\W\d_]+|[.!?;:\n]", text.lower())
    clauses, clause = [], []
    for t in tokens:
        if t in ".!?;:\n":
            clauses.append(clause)
            clause = []
        else:
            clause.append(t)
    for clause in [*clauses, clause]:
        weight = [lexicon.get(t) or next((stems[t[:k]] for k in range(len(t), 0, -1) if t[:k] in stems), None) for t in clause]
        free = lambda i: weight[i] is None and clause[i] not in threats
        near = lambda i, kind, reach: any(free(j) and clause[j] in kind for j in range(max(0, i - reach), i))
        negation, report = toxicity.NEGATIONS - toxicity.TARGETS, toxicity.REPORTS - toxicity.TARGETS - toxicity.NEGATIONS
        hits, waits = [], None
        for i, t in enumerate(clause):
            pattern = 3 if near(i, report, 6) else 2 if near(i, negation, 3) else 1 if near(i, toxicity.TARGETS, 4) else 0
            if weight[i] is not None:
                hits.append((pattern, weight[i], t))
            elif t in threats:
                waits = i if pattern == 0 else None
                if pattern == 1:
                    hits.append((1, threats[t], t))
            elif t in toxicity.TARGETS and waits is not None and i - waits <= 3:
                hits.append((1, threats[clause[waits]], clause[waits]))
                waits = None
        matched.add(frozenset({h[2]: h for h in hits}.values()))
    import math

    return [math.log1p(sum(w for c in matched for p, w, _ in c if p in over)) for over in ((0, 1, 2, 3), (0, 1), (1,))]


def test_features_equal_brute_force():
    r = random.Random(21)
    lexicon, stems = {"zork": 5.0, "fib": 2.5}, {"blarg": 4.0, "bla": 3.0}
    parts = ["zork", "fib", "blargung", "blau", "you", "not", "said", "kill", "hurt", "word", "other", "a", ".", "!", "\n", ",", "1", "You", "never", "du", "il", "x"]
    threats = {"kill": 4.0, "hurt": 1.5}
    grammar = toxicity.Grammar(lexicon, stems, threats)
    for _ in range(3000):
        text = " ".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert grammar.features(text) == pytest.approx(plain_features(text, lexicon, stems, threats)), text


def test_patterns_order_scores(spark):
    d = "/root/testdata/sf0.1"
    m = toxicity.fit(toxicity.training_rows(table(spark, d, "documents"), table(spark, d, "labels")))
    insult = max(sorted(m.words), key=m.words.get)
    score = lambda t: float(m.score([m.grammar.features(t)])[0])
    plain = score(f"what a {insult}")
    assert score(f"you are a {insult}") > plain > 0.5
    assert score("") < score(f"not a {insult}") < plain and score(f"someone said {insult}") < plain
    assert score("I will kill you tomorrow") > 0.5 > score("I will kill it tomorrow") == score("")
    assert score("I will never kill you") == score("")
    two = f"you are a {insult}. We will hurt you."
    assert score(two) > score(f"you are a {insult}.") and score(f"{two} {two}") == score(two)


def test_threats_are_learned_where_a_target_is_near(spark):
    import itertools

    words = [f"{a}{b}" for a, b in itertools.product(("ba", "ke", "lo", "mi", "nu"), ("rra", "sse", "tti", "ppo", "ddu"))]
    r = random.Random(5)
    fill = lambda: " ".join(r.choices(words, k=6))
    rows = [(f"{fill()} grome you {fill()}", 1) for _ in range(60)] + [(f"{fill()} grome the {r.choice(words)} {fill()} fine", 0) for _ in range(200)] + [(f"you {fill()}. burn you {fill()}", 0) for _ in range(60)]
    m = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    assert m.threats["grome"] > 1.5 and "grome" not in m.words and "burn" not in m.threats and "kill" in m.threats
    score = lambda t: float(m.score([m.grammar.features(t)])[0])
    assert score("they grome you") > 0.5 > score("grome the table") == score("")


def test_aimed_words():
    at = lambda t: sorted(f for f, _ in toxicity.aimed(toxicity.WORD.findall(t)))
    assert at("a b c d you e") == ["@b", "@c", "@d", "@e"] and at("you. a") == [] and at("") == []
    assert at("you a b c d e") == ["@a", "@b", "@c", "@d"] and at("a . you") == []


def test_composition_is_associative():
    import itertools

    a, b, c = toxicity.marker("target"), toxicity.marker("report"), toxicity.threats()
    left, right = toxicity.compose(toxicity.compose(a, b), c), toxicity.compose(a, toxicity.compose(b, c))
    for kinds in itertools.product(("threat", "target", "report", "end", "other"), repeat=4):
        s, t = left.start, right.start
        for k in kinds:
            s, x = left.step(s, toxicity.Symbol(k))
            t, y = right.step(t, toxicity.Symbol(k))
            assert x == y
    to, out = toxicity.compiled()
    assert len(to) == len(out) and all(set(row) == set(toxicity.KINDS) for row in to)


def test_op9_equals_a_plain_scorer(spark):
    import math
    import zlib

    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    got = {r.doc_id: r for r in queries()["op9_toxicity"](spark, d).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        z = sum(w * x for w, x in zip(model.weights, [*plain_features(t or "", model.words, model.stems, model.threats), 1.0], strict=True))
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_repeated_documents_and_clashing_columns_are_scored(spark, edge_texts):
    from pyspark.sql import functions as F

    docs = documents(spark, [(1, "a text"), (1, "a text"), (2, "you zork")]).withColumns({"SCORE": F.lit("x"), "label": F.lit(3), "predicted": F.lit(9)})
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.op9(docs, labels).collect()
    assert [r.doc_id for r in sorted(got)] == [1, 1, 2] and got[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    scored = toxicity.Toxicity({"zork": 5.0}, {}, [1.0] * toxicity.FEATURES + [-3.0]).score_documents(docs, out="score")
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "predicted", "score"]


def test_odd_training_tables(spark, edge_texts):
    docs = documents(spark, edge_texts)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(3, 12)] + [(None, 1, 1), (5, 1, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.op9(docs, known).collect()
        assert len(got) == len(edge_texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.op9(docs.limit(0), labels).count() == 0


def test_a_model_survives_its_text_form():
    m = toxicity.Toxicity({"zork": 5.0}, {"blarg": 4.0}, [0.5] * toxicity.FEATURES + [-3.0])
    again = toxicity.loaded(m.to_json())
    x = [again.grammar.features("you zork, blargs!")]
    assert m.score(x)[0] == again.score(x)[0] > 0.5


# --- urls --------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def plain_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_rules_equal_brute_force(spark):
    r = random.Random(1)
    parts = ["http://", "https://", "a.", "EXAMPLE.", "com", "net", "org", "/", "en/", "/en/7", "/de/", "/de/8", "/es/", "?x=/en/", "#f", "x", "://", ":8080", "notexample.com/en/7"]
    urls = [None, "", "://", "x"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 7))) for _ in range(500)] + ["http://" + h + p for h in ("com", "example.com", "w.example.net", "xcom", "B.Org") for p in ("/en/", "/en/7", "/de/8", "/es/", "", "/en")]
    got = {x.page_id: x for x in url_filter.op10(spark, spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES)).collect()}
    for i, u in enumerate(urls):
        host, path = plain_host_path(u)
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule.name if rule else None, rule.action if rule else "allow"), u


def test_rules_are_those_of_the_contract(spark):
    listed = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
    assert [(r.action, r.name) for r in url_filter.RULES] == listed
    link = '<link rel=canonical href="http://c.net/de/1">'
    rows = [(1, "http://c.net/de/1", None), (2, "http://example.net/de/7", None), (3, "http://w.example.net/de/81", link), (4, "http://d.org/q", link), (5, "http://b.org/es/", None)]
    got = {r.page_id: r.verdict for r in url_filter.op10(spark, spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "block"}


def test_block_spreads_over_aliases_and_allow_goes_first(spark):
    canonical = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://a.example.com/en/1", canonical("http://b.org/x")), (2, "https://b.org/x#part", None), (3, "http://B.org/y", '<META HTTP-EQUIV="refresh" content="0; url=/x">'),
        (4, "http://c.org/z", "<link href='//www.example.com/en/77?q=1' rel=canonical>"), (5, "http://www.example.com/en/77?q=1", ""), (6, None, None), (7, "nonsense", canonical("/x")),
        (8, "http://c.net/de/1", None), (9, "http://d.org/q", canonical("http://c.net/de/1")), (10, "http://e.org/both", canonical("http://c.org/z") + canonical("http://c.net/de/1")), (11, "http://f.org/q", '<a href="http://c.net/de/1">'), (11, "http://f.org/q", None),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: r.verdict for r in url_filter.op10(spark, pages).collect()}
    # 4, 5, 8, 9 and 10 are one class with explicit allows (5 and 8): pages without a rule are allowed.
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(url_filter.ORACLE).fetchall(), key=str) == sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in url_filter.op10(spark, pages).collect()), key=str)
    more = spark.createDataFrame([("http://f.org/q", "http://a.example.com/en/1"), (None, "x")], "src_url string, dst_url string")
    assert {r.verdict for r in url_filter.judge(spark, pages, edges=more).where("page_id = 11").collect()} == {"block"}
    assert url_filter.op10(spark, pages).count() == len(rows) and url_filter.op10(spark, pages.limit(0)).count() == 0


def test_chains_of_aliases(spark):
    rows = [(i, f"http://h{i}.org/p", f'<link rel=canonical href="http://h{i + 1}.org/p">') for i in range(30)] + [(30, "http://h30.org/p", '<link rel=canonical href="http://x.com/en/1">'), (31, "http://x.com/en/1", None)]
    got = url_filter.op10(spark, spark.createDataFrame(rows, PAGES)).collect()
    assert {r.verdict for r in got} == {"block"}
    assert components([1, 2], [(2, 1)]) == {1: 1, 2: 1}


def plain_node(url):
    """Host, folded path and query by hand."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)([^#]*)", url)
    if not m or not m[1]:
        return ""
    out = []
    parts = m[2][1:].split("/")
    for x in parts:
        if x == "..":
            out = out[:-1]
        elif x != ".":
            out.append(x)
    return m[1].lower() + "/" + "/".join(out) + ("/" if parts[-1] in (".", "..") and out else "") + m[3]


def test_links_resolve_as_by_the_standard_library(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    r = random.Random(12)
    part = lambda: r.choice(["a", "b.html", "..", ".", "c", "..", "d;x=1"])
    rows = []
    for i in range(800):
        base = "http://" + r.choice(["h.org", "H.org", "x.com:80"]) + "".join("/" + r.choice(["a", "b", "c.html"]) for _ in range(r.randint(1, 3))) + r.choice(["", "/", "?q=http://z.net/en/"])
        path = "/".join(part() for _ in range(r.randint(1, 4)))
        link = r.choice(["", "/", "//k.org/", "https://G.com/", "http://e.com"]) + path if r.random() < 0.8 else r.choice(["?y=1&x=http://x.com/en/1", "/out?u=http://x.com/en/1", "out?u=//x.com", "http://e.com", "http://e.com?z"])
        if link.startswith("http://e.com") and link[12:13] not in ("", "?", "/"):
            link = link[:12] + "/" + link[12:]
        rows.append((i, base, link))
    df = spark.createDataFrame(rows, "i int, base string, link string")
    got = {x.i: x.n for x in df.select("i", url_filter.node_of(url_filter.resolve(F.col("base"), F.col("link"))).alias("n")).collect()}
    assert [(b, k, got[i]) for i, b, k in rows if got[i] != plain_node(urljoin(b, k))] == []


def test_script_links_entities_comments_and_dot_segments(spark):
    import duckdb

    canonical = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://good.org/p", canonical("/out?u=http://x.com/en/1")), (2, "http://x.com/en/1", None),
        (3, "http://t.org/p", canonical("http://t.org/a?x=1&amp;y=2")), (4, "http://t.org/a?x=1&y=2", canonical("http://x.com/en/1")),
        (5, "http://u.org/p", "<!-- " + canonical("http://x.com/en/1") + " --> canonical"), (6, "http://v.org/p", "<!-- canonical <link rel=canonical href=http://x.com/en/1>"),
        (7, "http://w.org/a/b/c", canonical("../../../z/./q/..")), (8, "http://w.org/z/", canonical("http://x.com/a/../en/1")),
        (9, "http://y.org", canonical("mailto:a@x.com")), (10, "http://y.org/q", canonical("#x")), (11, "http://root.org", canonical("http://x.com/en/1")), (12, "http://root.org/", ""),
        (13, "http://long.org/p", "x" * 200_000 + canonical("http://x.com/en/1") + "y" * 200_000), (14, "http://rel.org", canonical("page")), (15, "http://rel.org/page", canonical("http://x.com/en/1")),
    ]
    got = {r.page_id: r.verdict for r in url_filter.op10(spark, spark.createDataFrame(rows, PAGES)).collect()}
    blocked = {2, 3, 4, 7, 8, 11, 12, 13, 14, 15}
    assert got == {i: "block" if i in blocked else "allow" for i, *_ in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert {r[0]: r[4] for r in con.sql(url_filter.ORACLE).fetchall()} == got
