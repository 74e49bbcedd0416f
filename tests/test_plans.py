"""What the physical plans must not contain, and what they must."""

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import QUERIES
from themeloom.operators import cleaning, similar, themes, tokens

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(spark, monkeypatch):
    """The plans of all tables that are staged or frozen on the way."""
    plans = []
    frame, writer = type(spark.range(1)), type(spark.range(1).write)
    parquet, checkpoint = writer.parquet, frame.checkpoint
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: plans.append(plan(self._df)) or parquet(self, *a, **k))
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **k: plans.append(plan(self)) or checkpoint(self, *a, **k))
    return plans


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_plan_joins_every_row_with_every_row(spark, name, written):
    for text in [plan(QUERIES[name](spark, SF)), *written]:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_plans_on_the_way_are_seen(spark, written):
    QUERIES["hierarchy_closure"](spark, SF)
    assert len(written) > 3


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "row_id")
    text = plan(cleaning.usable_texts(df).select("row_id"))
    assert "PushedFilters: [IsNotNull(text)" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    counted = plan(tokens.token_distribution(tokens.token_counts(df)))
    assert "ReadSchema: struct<text:string>" in counted


def test_copies_collapse_before_the_shuffle(spark):
    df = fx.documents(spark, SF)
    text = plan(cleaning.first_copies(df))
    partial = text.index("partial_min")
    assert text.index("Exchange hashpartitioning(_digest") < partial
    # The text itself is not shuffled for it, only its digest and the row's id.
    assert "Window" not in text and "SortAggregate" not in text


def test_theme_counts_are_hash_aggregated_in_two_steps(spark):
    text = plan(themes.theme_stats(fx.occurrences(spark, SF)))
    assert "partial_count" in text and "SortAggregate" not in text


def test_examples_limit_each_theme_before_the_shuffle(spark):
    assert "row_number(), 30, Partial" in plan(themes.example_rows(fx.occurrences(spark, SF)))


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(themes.sorted_themes(fx.stats(spark, SF), 10))
    assert "TakeOrderedAndProject" in plan(themes.known_themes(themes.register(fx.occurrences(spark, SF))))


def test_windows_without_partitions_see_reduced_tables_only(spark):
    """Ordered passes in one task come after an aggregate."""
    df = tokens.token_counts(fx.documents(spark, SF))
    text = plan(tokens.token_distribution(df))
    assert text.index("Window") < text.index("HashAggregate(keys=[n_tokens")


def test_cooccurrence_joins_on_themes_only(spark):
    text = plan(similar.cooccurrence(fx.merged_entries(spark, SF)))
    assert "[row_id" not in text.split("Join", 1)[1].split("\n", 1)[0]


@pytest.mark.parametrize("small", [True, False])
def test_only_places_and_names_meet_the_mapping(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(themes, "broadcast_if_small", lambda t: t.hint("merge"))
    entries = fx.entries(spark, SF).withColumn("summary", F.lit("a summary"))
    mapping = spark.createDataFrame([("a", "b")], "theme string, target string")
    text = plan(themes.map_themes(entries, mapping, "original", "merged"))
    by_theme = [line for line in text.splitlines() if "Exchange hashpartitioning(_theme" in line]
    assert len(by_theme) == (0 if small else 2)
    # Below the exchange by theme there are ids, places and names.
    generate = text.index("Generate posexplode")
    assert "summary" not in text[generate : text.index("\n", generate)]
    assert text.count("Exchange hashpartitioning(row_id") == 2


def test_texts_are_read_once_for_the_occurrences(spark):
    text = plan(themes.occurrences(fx.entries(spark, SF)))
    assert text.count("regexp_extract_all") == 1


def test_hot_theme_rows_agree_with_plain_counts(spark):
    """A theme on most rows: counts, examples and mapping stay whole."""
    entries = spark.range(5000).select(
        F.col("id").alias("row_id"),
        F.array(
            F.struct(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("theme"), F.lit(0.5).alias("confidence"))
        ).alias("original"),
    )
    stats = {r["theme"]: r["n"] for r in themes.theme_stats(themes.occurrences(entries)).collect()}
    assert stats["hot"] == 3333 and sum(stats.values()) == 5000
    mapping = spark.createDataFrame([("hot", "warm")], "theme string, target string")
    mapped = themes.map_themes(entries, mapping, "original", "m")
    assert mapped.count() == 5000
    assert mapped.filter(F.col("m")[0]["theme"] == "warm").count() == 3333
