"""Folded and refilled copies of benchmark items."""

from test_leak_edits import QUESTION, caught


def test_folded_wrapped_and_refilled_copies_are_found(spark):
    docs = [
        QUESTION.lower(),
        QUESTION.upper(),
        QUESTION.replace(" John", "\nJohn").replace(" Mary", "\nMary"),
        QUESTION.replace("7", "2.5").replace("15", "1,250"),
        QUESTION.replace("Mary", "Mary Ann Smith").replace("John", "Peter"),
    ]
    got = caught(spark, docs, [QUESTION])
    assert set(got) == {(i, 0) for i in range(5)}
    assert [got[i, 0].kind for i in range(5)] == ["verbatim"] * 3 + ["re-parameterised"] * 2
    assert all(r.coverage == 1 for r in got.values())
    assert got[3, 0].changed_slots == got[4, 0].changed_slots == 2
