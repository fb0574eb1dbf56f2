from pyspark.sql import functions as F

from clinspark.operators import text_rules
from clinspark.plans import catalog


def edits(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def test_word_error_rate_counts_the_whole_text(spark, tmp_path):
    texts = ["aaaa " * 100 + "losses of oil so close to also " * 40, "so also", "", None]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn int, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    noisy = rows.select("turn", text_rules.noisy(F.col("text"), F.col("turn"), 0.02, {"o": "0", "l": "1", "s": "5"}).alias("seen"))
    seen = {r.turn: (r.seen or "").lower().split() for r in noisy.collect()}
    got = {r.turn: r.wer for r in catalog.queries()["word_error_rate"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        assert abs(got[i] - (edits(seen[i], words) / len(words) if words else 0.0)) < 1e-5
    assert got[0] > 0
