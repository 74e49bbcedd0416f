import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import as_rows
from themeloom.llm import decontamination as dc

ITEMS = [
    (1, "Alice bought 12 apples for 3 dollars and gave Bob half of the apples before she went home at 5 o'clock."),
    (2, "What is the capital of the old kingdom by the sea?"),
    (3, "Too short now"),
    (4, None),
    (5, ""),
    (6, "1 2 3 4 5 6 7 8 9 10 11 12"),
    (7, "A train runs 60 km in 2 hours, so how far does a train run in 60 minutes at that speed?"),
]


def found(spark, docs, items=ITEMS, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in dc.matches(d, b, **options).collect()}


def test_verbatim_and_reparameterised_passages_are_found(spark):
    got = found(spark, [
        (1, f"Before it all. {ITEMS[0][1]} And after."),
        (2, "well then Carol bought 7 apples for 9 dollars and gave Dan half of the apples before she went home at 8 o'clock."),
        (3, "nothing of that kind is in here, 12 apples or not, and Alice went home"),
        (4, "WHAT IS the capital of the\nold kingdom by the sea"),
        (5, "some words and too short now again"),
        (6, "7 7 7 7 7 7 7 7 7 7 7 7"),
        (7, None),
        (8, ""),
    ])
    assert set(got) == {(1, 1), (2, 1), (4, 2), (5, 3)}
    assert got[1, 1]["verbatim"] and got[1, 1]["coverage"] == 1.0
    assert not got[2, 1]["verbatim"] and got[2, 1]["changed"] >= 3


def test_slots_must_be_consistent(spark):
    same = "A train runs 80 km in 3 hours, so how far does a train run in 80 minutes at that speed?"
    mixed = "A train runs 80 km in 3 hours, so how far does a train run in 90 minutes at that speed?"
    got = found(spark, [(1, same), (2, mixed)])
    assert set(got) == {(1, 7)}


def test_a_long_text_of_repeats_and_hot_passages(spark):
    text = ITEMS[1][1]
    docs = [(i, f"number {i} {text}") for i in range(300)] + [(999, f"{text} " * 400)]
    got = found(spark, docs)
    assert len(got) == 301 and got[999, 2]["matched"] == got[999, 2]["item_windows"]


def test_repeated_items_missing_and_repeated_ids(spark):
    items = [(1, ITEMS[1][1]), (2, ITEMS[1][1]), (None, ITEMS[1][1])]
    got = found(spark, [(5, ITEMS[1][1]), (5, ITEMS[1][1]), (None, ITEMS[1][1])], items)
    assert set(got) == {(5, 1), (5, 2)}


def test_empty_tables_and_clashing_columns(spark, edge, clashing, empty):
    bench = spark.createDataFrame([(1, edge.filter("doc_id = 1").head()["text"])], "item_id bigint, text string")
    assert dc.matches(empty, bench).collect() == []
    assert dc.matches(edge, bench.limit(0)).collect() == []
    assert as_rows(dc.matches(edge, bench), "doc_id") == [(1,), (5,), (6,)]
    assert as_rows(dc.matches(clashing.drop("item_id"), bench), "doc_id") == [(1,), (5,), (6,)]
    assert as_rows(dc.drop_contaminated(edge, bench), "doc_id") == sorted(((i,) for i in (2, 3, 4, 7, 8, 9, 10, 11, 12)), key=repr)


def test_templates(spark):
    text = "In 1999 Anna saw 3 km of road. Then Bob, Carl left; He paid 1,200.50 euros to Ms. Dupont"
    df = spark.createDataFrame([(text,)], "text string").select(dc.raw_tokens(F.col("text")).alias("raw"))
    row = df.select(dc.template(df["raw"]).alias("t")).head()["t"]
    assert row == ["in", "<number>", "<name>", "saw", "<number>", "<unit>", "of", "road", "then", "<name>", "<name>", "left", "he", "paid", "<number>", "<unit>", "to", "<name>", "dupont"]


def brute(docs, bench):
    """Document and item pairs of which the document holds half of the item's runs of 8 words."""
    word = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    pairs = set()
    for item, text in bench:
        w = word(text)
        runs = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for doc_id, other in docs:
            d = word(other)
            if len(runs & {tuple(d[i : i + 8]) for i in range(len(d) - 7)}) >= max(1, len(runs) / 2):
                pairs.add((doc_id, item))
    return pairs


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_documents(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert set(found(spark, docs, bench)) == brute(docs, bench)
