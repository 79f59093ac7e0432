"""The decontamination stage on re-parameterised, altered, short and number-heavy items."""

import pytest

import corpus_pipeline
from tallyspark.llm import op10_decontamination as op10

FILL = "Some unrelated filler text goes on here. " * 5


def kept(spark, docs, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in op10.drop_leaks(docs, bench).collect())


PETS = ("in a quiet village one old farmer keeps 2 dogs and 2 cats and feeds them with exactly 4 kg of dry food "
        "each day so how much food is needed for the whole week")
ITEM = ("Yesterday morning the farmer Anna walked 12 km to the market and sold 30 eggs to Peter for 45 cents each "
        "before Anna walked 12 km back home again")


@pytest.mark.parametrize("item,text", [
    (PETS, PETS.replace("2 dogs", "3 dogs").replace("2 cats", "5 cats")),
    (ITEM, ITEM.replace("Anna walked 12 km back", "Maria walked 77 km back")),
])
def test_a_slot_voids_only_its_windows(spark, make_docs, item, text):
    assert kept(spark, make_docs([(1, FILL + text + " " + FILL), (2, FILL), (None, FILL)]), [item]) == [-1, 2]


TOM = ("Tom has 5 apples. Tom buys 3 more apples at the shop near home. Later that day Tom gives 2 apples to a friend. "
       "How many apples are left in the end?")
SHOP = ("A shirt in the shop costs $15 and a hat costs $8 while a coat costs $60 more than the hat. "
        "What is the price of all of it after a discount of $9 at the till?")
CITY = 'The lady called "Émilie" went to see the town of Łódź with a friend and stayed there for (5) nights in a small hotel'


@pytest.mark.parametrize("item,text", [
    (TOM, TOM.replace("Tom", "Anna")),
    (SHOP, SHOP.replace("$15", "$25").replace("$8", "$11").replace("$60", "$75").replace("$9", "$4")),
    (CITY, CITY.replace("Émilie", "Zoë").replace("Łódź", "Århus").replace("(5)", "(7)")),
])
def test_names_and_numbers_with_marks(spark, make_docs, item, text):
    assert kept(spark, make_docs([(1, FILL + text + " " + FILL), (2, FILL)]), [item]) == [2]


FRANCE, SUM, DAYS = "What is the capital city of France?", "Compute 45 + 67 * 3.", "days after which all of it ends"


@pytest.mark.parametrize("item,text", [
    (FRANCE, "Question: " + FRANCE + " Answer: Paris"), (SUM, FILL + SUM + " Thanks"), (SUM, "(" + SUM.lower() + ")"),
    (DAYS, "it took 12 " + DAYS), ("12 30 42 7 9 4 5 6 8 11", "see 12 30 42 7 9 4 5 6 8 11 here"),
])
def test_short_and_number_heavy_items(spark, make_docs, item, text):
    assert kept(spark, make_docs([(1, text), (2, "Compute 45 - 67 * 3."), (3, None)]), [item]) == [2, 3]


def test_rows_without_id_and_shared_ids(spark, make_docs):
    docs = make_docs([(None, TOM), (None, FILL), (7, TOM), (7, FILL), (8, "")], extra=True)
    assert kept(spark, docs, [TOM, None, ""]) == [-1, 7, 8]
    assert kept(spark, docs, []) == [-1, -1, 7, 7, 8] and kept(spark, make_docs([]), [TOM]) == []
    bench = spark.createDataFrame([(1, TOM)], "item_id long, text string")
    assert op10.drop_leaks(docs, bench).columns == docs.columns and corpus_pipeline.op10_decontamination is op10
