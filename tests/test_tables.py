import pandas as pd
from pyspark.sql import functions as F

from clinspark.operators import ordered, tables, text_rules
from clinspark.plans import catalog

SHEET = "Ward 5 list\nBed    Name    Age    Diagnosis\nB1     Omar     67/M    STEMI\n                COPD\nB2     Sara     40/F   UTI"


def sheet(spark):
    words = text_rules.plain_text_words(spark.createDataFrame([("d", SHEET)], "doc_id string, text string"), "doc_id", "text")
    return ordered.row_bands(words).withColumns({"entity": text_rules.classify_token(F.col("text")), "confidence": F.lit(0.9)})


def test_header_is_the_row_of_header_words(spark):
    words = sheet(spark)
    assert [tuple(r) for r in tables.header_rows(words).collect()] == [("d", 1)]
    columns = tables.header_columns(words).orderBy("centre").collect()
    assert [c.role for c in columns] == ["bed", "name", "age", "dx"]


def test_words_below_become_records(spark):
    got = {(r.doc_id, r.bed, r.name) for r in catalog.queries()["table_records"](spark, "/root/testdata/sf0.001").collect()}
    assert got and all(b.startswith("B") and n == "Omar" for _, b, n in got)


def test_cells_of_one_role_merge():
    cells = pd.DataFrame({"role": ["name", "name", "name", "dx"], "cx": [10.0, 60.0, 300.0, 320.0], "confidence": [0.5, 0.9, 0.7, 0.8]})
    assert tables.merge_columns(cells).values.tolist() == [["name", 35.0, 2, 0.9], ["name", 300.0, 1, 0.7], ["dx", 320.0, 1, 0.8]]


def test_rows_that_carry_on():
    before = {"y": 0.0}
    row = lambda **k: {"y": 20.0, "left": 0.0, "roles": [], "hard": False, "soft": False, "identity": 1.0} | k
    assert tables.continues(before, row(roles=["dx", "meds"]), 0.0, 20.0)
    assert not tables.continues(before, row(roles=["dx"], hard=True), 0.0, 20.0)
    assert not tables.continues(before, row(roles=["dx"], y=200.0), 0.0, 20.0)
    assert tables.continues(before, row(roles=["name"], left=90.0, soft=True), 0.0, 20.0)
    assert not tables.continues(before, row(roles=["name"], soft=True), 0.0, 20.0)
    assert not tables.continues(None, row(roles=["dx"]), 0.0, 20.0)


def test_clusters_split_only_between_strong_rows():
    rows = pd.DataFrame({"cx": [0, 1, 0, 0, 1], "cy": [0, 0, 40, 80, 80], "h": 20.0, "entity": ["BED", "NAME", "DIAGNOSIS", "BED", "NAME"]})
    assert tables.split_cluster(rows)["part"].tolist() == [0, 0, 0, 1, 1]
    assert tables.split_cluster(rows.head(4))["part"].tolist() == [0] * 4
    assert tables.split_cluster(rows.assign(entity=["BED", "NAME", "AGE", "GENDER", "GENDER"]))["part"].tolist() == [0] * 5


def test_only_lagging_rosters_are_repaired(spark):
    rows = [("a", 1, None, "c1"), ("a", 2, "p2", "c2"), ("a", 3, "p3", None), ("b", 1, "p1", "c1"), ("b", 2, "p2", "c2"), ("b", 3, "p3", None)]
    got = tables.repair_lag(spark.createDataFrame(rows, "doc_id string, line int, identity string, clinical string")).orderBy("doc_id", "line").collect()
    assert [(r.doc_id, r.identity, r.clinical) for r in got] == [("a", "p2", "c1"), ("a", "p3", "c2"), ("b", "p1", "c1"), ("b", "p2", "c2"), ("b", "p3", None)]


def test_guards(spark):
    s = lambda x: F.lit(x).cast("string")
    row = spark.range(1).select(
        tables.strong_identity(s("x"), s(None), s("3"), s(None)).alias("a"), tables.strong_identity(s("x"), s(None), s(None), s(None)).alias("b"),
        tables.adds_detail([s(None), s("x")], [s("y"), s(None)]).alias("c"), tables.adds_detail([s("z")], [s("y")]).alias("d"),
        tables.learned_label(F.lit(0), F.lit(0.8), F.lit(0.9), F.lit(0.0)).alias("e"), tables.section_row(F.array(s("ward")), F.lit(0), F.lit(2)).alias("f"), tables.section_row(F.array(s("bed")), F.lit(2), F.lit(2)).alias("g"),
    ).first()
    assert tuple(row) == (True, False, True, False, "NAME", True, False)
