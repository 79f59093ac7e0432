"""Operator 10: planted copies and re-parameterised questions, and odd rows."""

import pytest

from tallyspark.llm import op10_decontamination as op10

ITEM = ("Yesterday morning the farmer Anna walked 12 km to the market and sold 30 eggs to Peter for 45 cents each "
        "before Anna walked 12 km back home again")
SHORT = "count seven green apples quickly"
OTHER = "plain words only and nothing else here that could ever match with some other text at all"


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, SHORT), (3, OTHER), (4, None), (5, "too short"), (3, OTHER)],
                                 "item_id long, text string").selectExpr("*", "'x' as doc_id", "'y' as hash")


FILL = "Some unrelated filler text goes on here. " * 5
CHANGED = ITEM.replace("Anna", "Maria").replace("12", "99").replace("Peter", "Klaus").replace("45", "3.5").replace("km", "miles")


@pytest.mark.parametrize("text,found,same", [
    (FILL + ITEM + " " + FILL, {1}, True), (FILL + CHANGED, {1}, False), (CHANGED.upper(), set(), None),
    (ITEM.replace("Anna walked 12 km back", "Maria walked 77 km back"), {1}, None),
    ((FILL + OTHER.upper() + "\n\t" + FILL), {3}, True), (FILL, set(), None), ("x " + SHORT + " y", {2}, True),
    (ITEM[:40], set(), None), (None, set(), None), ("", set(), None), (FILL * 400 + OTHER, {3}, True),
])
def test_planted(make_docs, bench, text, found, same):
    got = op10.leaks(make_docs([(7, text), (8, "clean words"), (None, "clean")], extra=True), bench).collect()
    if text and "Maria walked 77" in text:  # 12 stands for two values: windows over either place disagree on one diagonal
        assert got == []
        return
    assert {r["item_id"] for r in got} == found and {r["doc_id"] for r in got} <= {7}
    if same is not None:
        assert all(r["same_values"] == same for r in got)


def test_rows_and_empty_tables(spark, make_docs, bench):
    docs = make_docs([(7, OTHER), (7, OTHER), (9, FILL), (None, OTHER)])
    kept = op10.drop_leaks(docs, bench).collect()
    assert [r["doc_id"] for r in kept] == [9]       # a contaminated row goes, with an id or without
    assert op10.leaks(make_docs([]), bench).count() == 0
    assert op10.leaks(docs, bench.limit(0)).count() == 0
