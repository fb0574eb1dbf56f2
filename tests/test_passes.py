import random
import re

import pytest
from pyspark.sql import functions as F

from clinspark.operators import evidence, passes, weighted
from clinspark.plans import lexicons

BLANK = " \t\n\r\f\v"


def cased(model, word):
    return word.upper() if model == model.upper() else word[0].upper() + word[1:] if model[0] == model[0].upper() else word.lower()


def least(rows):
    out = {}
    for seen, meant in rows:
        if seen and meant is not None:
            out[seen] = min(out.get(seen, meant), meant)
    return out


def plain(text, confusables, phrases, dictionary, known):
    """Corrected text and changes, word by word."""
    if text is None:
        return None, []
    changes = []
    whole, parts = least((s, m) for s, m, w in confusables if w), least((s, m) for s, m, w in confusables if not w)
    phrases = least((s.strip().lower(), m) for s, m in phrases if s)
    dictionary, known = least((s.lower(), m) for s, m in dictionary if s), {w.lower() for w in known}

    def replaced(number, at, n, meant, method):
        first, last = core(units[at[0]]), core(units[at[n - 1]])
        a, b = at[0], at[n - 1]
        lead = units[a].index(first)
        trail = units[b].rindex(last) + len(last)
        whole_text = "".join(units[a : b + 1])
        original = whole_text[lead : len(whole_text) - (len(units[b]) - trail)]
        if original != meant:
            changes.append((number, words.index(a), original, meant, method))
            tail = units[b][trail:]
            units[a] = units[a][:lead] + meant + tail
            for k in range(a + 1, b + 1):
                units[k] = ""

    core = lambda t: t.strip(passes.PUNCTUATION)

    def pass_words():
        for at in words:
            w = core(units[at])
            if w:
                yield at, w

    def read():
        return re.findall(r"[ \t\n\r\f\v]+|[^ \t\n\r\f\v]+", text)

    units = read()
    words = [i for i, u in enumerate(units) if u[0] not in BLANK]
    for at, w in list(pass_words()):
        if w in whole:
            new = whole[w]
        else:
            new, i = "", 0
            while i < len(w):
                hit = max((p for p in parts if w.startswith(p, i)), key=len, default=None)
                new, i = (new + parts[hit], i + len(hit)) if hit else (new + w[i], i + 1)
        if new != w:
            replaced(1, [at], 1, new, "confusable")
    text = "".join(units)
    units = read()
    words = [i for i, u in enumerate(units) if u[0] not in BLANK]
    split = {tuple(s.split()): m for s, m in phrases.items()}
    i = 0
    while i < len(words):
        for n in range(min(8, len(words) - i), 0, -1):
            run = words[i : i + n]
            meant = split.get(tuple(core(units[k]).lower() for k in run))
            if meant is not None:
                replaced(2, run, n, meant, "phrase")
                i += n - 1
                break
        i += 1
    text = "".join(units)
    units = read()
    words = [i for i, u in enumerate(units) if u[0] not in BLANK]
    for at, w in list(pass_words()):
        low = w.lower()
        if len(w) < 3:
            continue
        tries = [(low.replace(a, b), False) for a, b in passes.SWAPS] + [(low.replace("rn", "m"), True), (low.replace("1", "l"), True), (low.replace("rn", "m").replace("1", "l"), True)]
        if len(low) > 3:
            tries += [(low[:k] + "i" + low[k + 1 :], True) for k in range(1, len(low)) if low[k] == "l"]
        new, method = dictionary.get(low), "dictionary"
        if new is None:
            method = "char_swap"
            for s, fine in tries:
                if s != low and (s in dictionary or (fine and s in known)):
                    new = dictionary.get(s, s)
                    break
        if new is not None and new.lower() != low:
            replaced(3, [at], 1, cased(w, new), method)
    return "".join(units), changes


def compare(got, rows, tables):
    for r in got:
        want = plain(rows[r.k], *tables)
        assert (r.corrected, [(c["pass"], c["place"], c["original"], c["corrected"], c["method"]) for c in r.corrections]) == want, rows[r.k]


CONFUSABLES = [("lV", "IV", True), ("vv", "w", False), ("vvv", "uw", False), ("A1-", "Al-", False), ("a1", "al", False), ("lV", "JV", True), (None, "x", True), ("", "y", False)]
PHRASES = [("c/o sob", "complains of shortness of breath"), ("k/c/o", "known case of"), ("K/C/O dm", "known diabetic"), ("never seen", "x"), (" acute  kidney injury", "AKI"), ("kidney", "renal")]
DICTIONARY = [("metforrnin", "Metformin"), ("dally", "daily"), ("asprin", "aspirin"), ("asprin", "zaspirin"), ("insulin", "insulin"), ("daily", "daily")]
KNOWN = ["amiodarone", "pneumonia", "hospital", "modem", "infarction", "Treatment"]
TEXTS = [
    None, "", "   ", "lV fluids, vvvalk vvith A1-Sabah a1 (lV)!", "Patient C/O  SOB. k/c/o DM; k/c/o HTN", "acute kidney injury, kidney stone",
    "ASPRIN 75mg PO Dally; Metforrnin 500", "arniodarone pneurnonia Hospita1 HOSPlTAL lnfarction infarctlon", "modern treatrnent dai1y", "\t leads\n and trails \r\n", "Hb 72 k: 0.2 Na 140 glucose 4000 INR 1.0",
    "vv", "(((", "a1a1vvvvv", "asprin asprin, \"asprin\"", "İI ß 日本 dally",
]


@pytest.fixture(scope="module")
def tables(spark):
    pair = "seen string, meant string"
    return (spark.createDataFrame(CONFUSABLES, pair + ", whole boolean"), spark.createDataFrame(PHRASES, pair), spark.createDataFrame(DICTIONARY, pair), spark.createDataFrame([(w,) for w in [*KNOWN, None]], "word string"))


def test_passes_equal_a_plain_version(spark, tables):
    texts = [*TEXTS, *TEXTS[3:5], " ".join(TEXTS[3:10]) * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumns({"flags": F.lit(1), "row": F.lit("x"), "Corrected": F.lit(2)})
    got = passes.correct(rows, "t", *tables)
    assert got.columns == ["k", "t", "row", "corrected", "corrections", "flags"] and got.count() == len(texts)
    got = got.collect()
    compare(got, texts, ([c for c in CONFUSABLES], PHRASES, DICTIONARY, KNOWN))
    flags = {r.k: [(f.name, f.value) for f in r.flags] for r in got}
    assert ("k", 0.2) in flags[10] and ("glucose", 4000.0) in flags[10] and not any(n in ("na", "inr") for n, _ in flags[10]) and flags[0] == flags[1] == []
    assert passes.correct(rows.limit(0), "t", *tables).count() == 0
    empty = passes.correct(rows, "t", *[t.limit(0) for t in tables]).collect()
    assert all(r.corrected == texts[r.k] and r.corrections == [] for r in empty)


def test_many_automata_find_the_same(spark, tables):
    words = spark.createDataFrame([(w,) for w in ("vvvalk", "A1-a1", "vvvvv", "none")], "core string")
    few = sorted(map(str, passes.confusable_fixes(words, tables[0]).collect()))
    assert few == sorted(map(str, passes.confusable_fixes(words, tables[0], most_bytes=4).collect())) and len(few) == 3


def test_phrases_that_share_words_meet_only_where_they_are(spark, tables, monkeypatch):
    words = [f"w{i}x" for i in range(10)]
    phrases = [(f"{a}  {b.upper()}", f"{a}_{b}") for i, a in enumerate(words) for j, b in enumerate(words) if j != (i + 1) % 10 or i == 3]
    phrases += [("w5x w6x w7x", "longer"), ("w5x w6x  w7x", "long"), ("w8x w9x w0x w2x", "never"), ("(( w1x", "never")]
    texts = [" ".join(f"({words[(k + i) % 10]}," for i in range(40)) for k in range(10)] + ["w5x w6x", "\n w3x\tW4X \n", "(( w1x"]
    met, apply = {}, passes._apply

    def counted(rows, hits, number):
        met[number] = hits.count()
        return apply(rows, hits, number)

    monkeypatch.setattr(passes, "_apply", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = passes.correct(rows, "t", tables[0], spark.createDataFrame(phrases, "seen string, meant string"), tables[2].limit(0), tables[3].limit(0)).collect()
    compare(got, texts, (CONFUSABLES, phrases, [], []))
    assert met[2] == sum(c["pass"] == 2 for r in got for c in r.corrections) > 70


def test_the_tables_texts_equal_a_plain_version(spark, tiny):
    rows = lexicons.misread_texts(spark, tiny)
    tables = [[tuple(r) for r in t.collect()] for t in lexicons.lexicon_tables(spark, tiny)]
    tables[3] = [r[0] for r in tables[3]]
    key = F.concat_ws("/", "conv_id", "turn")
    texts = {r.k: r.seen for r in rows.select(key.alias("k"), "seen").collect()}
    got = lexicons.correction_passes(spark, tiny).withColumn("k", key).collect()
    assert len(got) == len(texts) and {c.method for r in got for c in r.corrections} == {"confusable", "phrase", "dictionary", "char_swap"}
    compare(got, texts, tables)


# --- evidence -------------------------------------------------------------------------------------------------------------


def test_the_longest_phrases_go_first(spark):
    lex = spark.createDataFrame([("a b",), ("b c d",), ("d",), ("D",), ("e f",), ("f g",), ("x y z w",), (None,), ("",)], "term string")
    texts = ["a b c d", "a b x", "d d, D!", "e f g", "x/y;z w b c", None, "", "(a) b. c d e f g", "a b c d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("found", F.lit(1))
    got = {r.k: ([h.term for h in r.found], r.spoken, r.leads) for r in evidence.evidence(rows, "t", lex).collect()}
    assert got[0] == got[8] == (["b c d"], "a b c d", False)
    assert got[1] == (["a b"], "a b x", True) and got[2] == (["D", "D", "D"], "D D D!", True)[:1] + (got[2][1], True)
    assert got[3][0] == ["e f"] and got[4] == (["x y z w"], "x y z w b c", True)
    assert got[5] == ([], None, False) and got[6] == ([], "", False) and got[7][0] == ["b c d", "e f"]
    assert all(r.found == [] for r in evidence.evidence(rows, "t", lex.limit(0)).collect())


def test_near_phrases_equal_a_plain_version(spark):
    from clinspark.functions.distance import weighted_distance

    r = random.Random(4)
    terms = ["SEPTIC SHOCK", "SHOCK", "ACUTE KIDNEY INJURY", "KIDNEY", "COPD", "UTI", "DIABETES MELLITUS", "MI"]
    texts = []
    for _ in range(60):
        t = " ".join(r.choice([*terms, "with", "old", "no"]) for _ in range(r.randint(0, 7)))
        texts.append("".join(c if r.random() > 0.06 else r.choice(["", "0", "1", c + "x", c.lower()]) for c in t))
    costs = spark.createDataFrame(weighted.confusable_costs(), "a string, b string, cost double")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {x.k: [(h.start, h.n, h.term, round(h.distance, 6), round(h.confidence, 6)) for h in x.found] for x in evidence.evidence(rows, "t", spark.createDataFrame([(t,) for t in terms], "term string"), costs).collect()}
    key = lambda s: re.sub(r"[\W_]", "", s.upper())
    for k, t in enumerate(texts):
        w = [x for x in (re.sub(r"""^[.:()\[\]"']+|[.:()\[\]"']+$""", "", p) for p in re.split(r"[ \t\r\n,;/|]+", t)) if x]
        hits = []
        for i in range(len(w)):
            for n in range(1, min(4, len(w) - i) + 1):
                own = key(" ".join(w[i : i + n]))
                if not own:
                    continue
                d, term = min((round(weighted_distance(own, key(x)), 9), key(x), x) for x in terms)[::2]
                if d <= 1 and (d == 0 or n > 1 or len(own) > 3):
                    hits.append({"start": i, "n": n, "term": term, "distance": d, "confidence": 1.0 if d == 0 else max(0.0, 1 - d / max(len(own), len(key(term))))})
        assert got[k] == [(h["start"], h["n"], h["term"], round(h["distance"], 6), round(h["confidence"], 6)) for h in evidence.chosen(hits)], t


def test_letters_keep_their_number_in_capitals(spark, tmp_path):
    import duckdb

    words = ["SS", "ß", "ẞ", "straße", "STRASSE", "ﬁn", "fin", "FIN", "ŉ", "ᾀb", "ᾈB", "ǰ", "éa", "ÉA", "ſt", "ST", "strasse"]
    assert [r.k for r in spark.createDataFrame([(w,) for w in words], "w string").select(evidence.lexicon_key(F.col("w")).alias("k")).collect()] == [r[0] for r in duckdb.execute("SELECT regexp_replace(upper(w), '[^\\p{L}\\p{N}]', '', 'g') FROM (SELECT unnest(?) AS w)", [words]).fetchall()]
    rows = [(1, 0, "user", "a ß b straße fin"), (1, 1, "assistant", "x y SS STRASSE ﬁn"), (2, 0, "user", "SS ss Straße"), (2, 1, "assistant", "p q ß")]
    duckdb.execute("CREATE OR REPLACE TABLE t (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    duckdb.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    duckdb.execute(f"COPY t TO '{tmp_path}/conversations.parquet' (FORMAT parquet)")
    sql = lexicons.SQL["phrase_evidence"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet'")
    got = [r.asDict() for r in lexicons.phrase_evidence(spark, str(tmp_path)).collect()]
    found = duckdb.sql(sql)
    assert sorted(map(str, got)) == sorted(str(dict(zip(found.columns, r, strict=True))) for r in found.fetchall())


def test_a_pass_shuffles_texts_and_hits_once(spark):
    rows = spark.range(4).select(F.col("id").alias("row"), F.lit(b"x").alias("sha"), F.lit("a b").alias("text"), F.array().cast(passes.CHANGE).alias("corrections")).localCheckpoint()
    hits = spark.createDataFrame([(1, 0, 1, None, "c", "m")], "row long, place int, n int, words array<string>, meant string, method string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = passes._apply(rows, hits, 1)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(row") == 2
        assert {r.row: r.text for r in out.collect()} == {0: "a b", 1: "c b", 2: "a b", 3: "a b"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
