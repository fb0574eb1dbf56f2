"""Short items, and items of hardly any literals."""

from test_leak_edits import caught


def test_short_and_placeholder_heavy_items_are_found(spark):
    dense = "Add 3 kg 5 g and 7 kg 9 g to 12 kg 4 g then 8 kg 6 g or 1 kg 2 g"
    short = "What is the capital of France"
    got = caught(spark, ["well " + dense + " so", "he asked: what is the capital of France? Paris", "the capital of France is what", ""], [dense, short, "", None])
    assert {k: r.coverage for k, r in got.items()} == {(0, 0): 1.0, (1, 1): 1.0}
