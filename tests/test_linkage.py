import random

import pytest
from pyspark.sql import functions as F

from clinspark.functions.distance import weighted_distance
from clinspark.operators import linkage, weighted

NAMES = ["bed", "civil_id", "full_name", "gender", "age", "dx", "meds"]
SCHEMA = "id long, bed string, civil_id string, full_name string, gender string, age int, dx string, meds string"


def rec(bed=None, civil_id=None, full_name=None, gender=None, age=None, dx=None, meds=None):
    return (bed, civil_id, full_name, gender, age, dx, meds)


#: What the rules say of two records, one case for each rule and its edges.
CASES = [
    (rec(bed="A1", full_name="X"), rec(bed="a 1", full_name="OTHER NAME", gender="F"), True),
    (rec(bed="A1", civil_id="2"), rec(bed="A2", civil_id="2"), False),
    (rec(bed="A1", civil_id="123456789012"), rec(civil_id="123456789012", full_name="ANY", gender="M"), True),
    (rec(civil_id="1", full_name="SAME NAME"), rec(civil_id="2", full_name="SAME NAME"), False),
    (rec(bed="A1", full_name="AHMED SALEM", age=20), rec(full_name="AHMED SALEN", age=80), True),
    (rec(bed="A1", full_name="AHMED SALEM", gender="M"), rec(full_name="AHMED SALEM", gender="F"), False),
    (rec(full_name="AHMED SALEM", age=20), rec(full_name="AHMED SALEM", age=29), False),
    (rec(full_name="AHMED SALEM", age=20), rec(full_name="AHMED SALEM", age=28), True),
    (rec(full_name="PETER", age=50, dx="chf", meds="aspirin"), rec(full_name="QUINCY", age=51, dx="acute CHF", meds="ASPIRIN 75"), True),
    (rec(full_name="PETER", age=50, dx="chf", meds="aspirin"), rec(full_name="QUINCY", age=51, dx="acute CHF", meds="heparin"), False),
    (rec(full_name="PETER", age=50, dx="chf", meds="aspirin"), rec(full_name="QUINCY", age=52, dx="chf", meds="aspirin"), False),
    (rec(full_name="PETER", age=50, dx="chf"), rec(full_name="QUINCY", age=50, dx="chf", meds="heparin"), True),
    (rec(full_name="PETER", age=50, meds="heparin"), rec(full_name="QUINCY", age=50, dx="chf", meds="heparin"), True),
    (rec(full_name="PETER", dx="chf"), rec(full_name="QUINCY", age=50, dx="chf"), False),
    (rec(full_name="PETER", age=50, dx="chf", gender="M"), rec(full_name="QUINCY", age=50, dx="chf", gender="F"), False),
    (rec(full_name="ALI"), rec(full_name="ALE"), True),
    (rec(full_name="ALI"), rec(full_name="OLE"), False),
    (rec(full_name="MARIAM"), rec(full_name="MARYEM"), False),
    (rec(full_name="ALEXANDER"), rec(full_name="ALEXENDRR"), True),
    (rec(full_name="ALEXANDER", age=30), rec(full_name="ELEXENDRRS", age=32), True),
    (rec(full_name="ALEXANDER", age=30), rec(full_name="ELEXENDRRS", age=33), False),
    (rec(full_name="ALEXANDER"), rec(full_name="ELEXENDRRST"), False),
    (rec(full_name="AL BO CE"), rec(full_name="EL BA CO"), True),
    (rec(), rec(), False),
    (rec(full_name=" ", bed=""), rec(full_name=" ", bed=" "), False),
]


def merged(a, b, costs=None):
    """The rules, one after another."""
    bed = lambda r: (r[0] or "").replace(" ", "").replace("\t", "").upper().translate(str.maketrans("OQ|IL", "00111")) or None
    name = lambda r: " ".join("".join(c if c.isascii() and c.isalpha() or c == " " else " " if c == "\t" else "" for c in (r[2] or "")).upper().split()) or None
    key = lambda t: "".join(c for c in (t or "").upper() if c.isalnum()) or None
    number = lambda r: (r[1] or "").replace(" ", "") or None
    if bed(a) and bed(b):
        return bed(a) == bed(b)
    if number(a) and number(b):
        return number(a) == number(b)
    fit = not a[3] or not b[3] or a[3] == b[3]
    d = weighted_distance(name(a), name(b), costs or {}) if name(a) and name(b) else None
    gap = abs(a[4] - b[4]) if a[4] is not None and b[4] is not None else None
    if d is not None and d <= 1 and (bed(a) is None) != (bed(b) is None) and fit:
        return True
    if not fit or (gap is not None and gap > 8):
        return False
    inside = lambda i: bool(key(a[i]) and key(b[i]) and (key(a[i]) in key(b[i]) or key(b[i]) in key(a[i])))
    lacks = lambda i: not key(a[i]) or not key(b[i])
    partial = not (name(a) and name(b) and bed(a) and bed(b))
    if partial and gap is not None and gap <= 1 and ((inside(5) and (inside(6) or lacks(6))) or (inside(6) and (inside(5) or lacks(5)))):
        return True
    if d is None:
        return False
    several = " " in a[2].strip() and " " in b[2].strip()
    short = not several and min(len(name(a)), len(name(b))) < 8
    if d <= (1 if short else 2):
        return True
    return not short and (gap is None or gap <= 2) and d <= 4


def test_each_rule(spark):
    rows = spark.createDataFrame([(i, *a, *b) for i, (a, b, _) in enumerate(CASES)], "i int, " + ", ".join(f"{p}_{n} {'int' if n == 'age' else 'string'}" for p in "ab" for n in NAMES))
    sides = []
    for p in "ab":
        sides.append(rows.select("i", *[F.col(f"{p}_{n}").alias(n) for n in NAMES]).select("i", *linkage.profile_columns()).select("i", F.struct(*linkage.FIELDS).alias(p)))
    both = sides[0].join(sides[1], "i")
    d = F.levenshtein(F.col("a.name"), F.col("b.name"))
    say = lambda x, y: linkage.should_merge({c: F.col(f"{x}.{c}") for c in linkage.FIELDS}, {c: F.col(f"{y}.{c}") for c in linkage.FIELDS}, F.when(d <= 4, d))
    got = {r.i: (r.x, r.y) for r in both.select("i", say("a", "b").alias("x"), say("b", "a").alias("y")).collect()}
    for i, (a, b, want) in enumerate(CASES):
        assert got[i] == (want, want) and merged(a, b) == want, CASES[i]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    r = random.Random(seed)
    base = ["AHMED SALEM", "MARIAM", "ALEXANDER", "O'NEIL JO", "ALI", "NOORA HASSAN AL"]
    slip = lambda t: "".join(c if r.random() > 0.08 else r.choice(["", c + "X", "O", "Q"]) for c in t)
    pick = lambda share, *xs: r.choice(xs) if r.random() < share else r.choice([None, "", " "])
    rows = []
    for i in range(130):
        rows.append((i, pick(0.25, "A1", "A 2", "B3", "b4", "C5", "C6"), pick(0.1, "111", "222", "333"), pick(0.8, *map(slip, base)), r.choice([None, "M", "F"]), r.choice([None, *range(20, 90, 3)]), pick(0.5, "chf", "acute chf", "ckd 5", "x", "xy"), pick(0.7, *"aspirin,aspirin 75,heparin,insulin,q,qr".split(","))))
    rows += [(200, *rows[3][1:]), (201, *rows[3][1:]), (202, *rec()), (203, *rec()), (-5, *rec(full_name="ALI")), (None, *rec(full_name="ALI")), (204, *rec(full_name="ALI", age=400))]
    costs = {("0", "o"): 0.2, ("o", "q"): 0.3}
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"group": F.lit("x"), "text": F.lit(1)})
    got = {x.id: x.group for x in linkage.link(table, "id", spark.createDataFrame([(a, b, c) for (a, b), c in costs.items()], "a string, b string, cost double")).collect()}
    root = {x[0]: x[0] for x in rows if x[0] is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [x for x in rows if x[0] is not None]
    for n, a in enumerate(known):
        for b in known[n + 1 :]:
            if merged(a[1:], b[1:], costs):
                x, y = sorted((top(a[0]), top(b[0])))
                root[y] = x
    assert got == {i: top(i) for i in root}
    assert 10 < len(set(got.values())) < len(got)


def test_containing_texts(spark):
    texts = ["abc", "xabcx", "ab", "b", "zzz", "abcabc", "é", "aéa", ""]
    got = {(x.inner, x.outer) for x in linkage.containing(spark.createDataFrame([(t,) for t in [*texts, None, "abc"]], "text string")).collect()}
    assert got == {(a, b) for a in texts for b in texts if a and a in b}


def test_links_grow_with_the_records_not_with_their_pairs(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, *rec(full_name="AHMED SALEM"[: 11 - i % 2], gender=r.choice("MF"), age=r.choice([None, *range(20, 80)]), dx=r.choice(["chf", "acute chf", None]), meds=f"drug {i}", civil_id=str(i) if i % 5 == 0 else None)) for i in range(400)]
    edges = []
    merge = linkage.merge_groups
    monkeypatch.setattr(linkage, "merge_groups", lambda nodes, key, links, **kw: (edges.append(links.count()), merge(nodes, key, links, **kw))[1])
    groups = {x.group for x in linkage.link(spark.createDataFrame(rows, SCHEMA), "id", spark.createDataFrame([], "a string, b string, cost double")).collect()}
    assert 1 <= len(groups) <= 2
    assert sum(edges) < 10 * len(rows)  # pairs would be tens of thousands


def test_ages_are_linked_in_steps_and_no_further(spark):
    """Chains of ages of one name: steps of 8 hang together, of 9 don't; those with a number go by others alone."""
    rows = [(i, *rec(full_name="AHMED SALEM", gender="M", age=a, civil_id=c)) for i, (a, c) in enumerate([(10, None), (18, "1"), (26, None), (35, None), (43, "2"), (51, "3"), (60, None), (90, "4"), (90, "5")])]
    got = {x.id: x.group for x in linkage.link(spark.createDataFrame(rows, SCHEMA), "id", spark.createDataFrame([], "a string, b string, cost double")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
