"""Benchmark items under five words, by hand and in odd tables."""
from tidemark.llm import decontaminate as dc


def tables(spark, items):
    docs = spark.createDataFrame([(1, "The Answer is forty two , of course it is"), (2, "forty  two"), (3, "two forty"), (4, "fortytwo forty twos"), (5, None), (6, " "),
                                  (2, "forty  two"), (7, "one long passage of nine words stands right here")], "doc_id long, text string")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_short_items_by_hand(spark):
    docs, items = tables(spark, [(1, "Forty\ttwo"), (2, "is"), (3, None), (4, ""), (5, "is forty two ,"), (6, "passage of nine words stands"), (2, "is"), (None, "two forty")])
    rows = [(r.doc_id, r.item_id) for r in dc.short_contained(docs, items).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 1), (1, 2), (1, 5), (3, None)], key=str)


def test_no_short_items_and_empty_tables(spark):
    docs, items = tables(spark, [(6, "passage of nine words stands"), (3, None), (1, "is")])
    assert dc.short_contained(docs, items.where("item_id <> 1")).count() == 0
    assert dc.short_contained(docs.where("doc_id = -1"), items).count() == 0 == dc.short_contained(docs, items.where("item_id = -1")).count()


def test_short_items_in_odd_tables(spark, odd):
    items = spark.createDataFrame([(4, "one two three"), (8, "one"), (9, "\U0001F600 é")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.short_contained(odd, items).collect()) == [(5, 8), (6, 4), (6, 8), (9, 9), (10, 4), (10, 8)]
