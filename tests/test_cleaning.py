import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from themeloom.functions.ordering import dense_index
from themeloom.functions.text import WHITESPACE, strip
from themeloom.operators import cleaning


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "row_id bigint, text string")


def cleaned(spark, *values, **options):
    rows = cleaning.clean_texts(texts(spark, *values), **options).orderBy("idx").collect()
    return [(r["row_id"], r["text"], r["idx"]) for r in rows]


def test_null_and_blank_texts_go(spark):
    assert cleaned(spark, None, "", "   ", " 　\t      ", "hello there") == [(4, "hello there", 0)]


def test_length_counts_before_stripping(spark):
    assert cleaned(spark, "  ab ", "abcd") == [(0, "ab", 0)]


def test_length_counts_code_points(spark):
    assert cleaned(spark, "éèêçà", "\U0001f600" * 4, "\U0001f600" * 5) == [(0, "éèêçà", 0), (2, "\U0001f600" * 5, 1)]


def test_unicode_white_space_is_stripped_and_zero_width_is_not(spark):
    assert cleaned(spark, " xxxxxx　", "​xxxxxx") == [(0, "xxxxxx", 0), (1, "​xxxxxx", 1)]


def test_first_copy_stays(spark):
    assert cleaned(spark, "hello ", "hello", "other", "\thello") == [(0, "hello", 0), (2, "other", 1)]
    assert len(cleaned(spark, "hello ", "hello", drop_duplicates=False)) == 2


def test_case_and_accents_distinguish_copies(spark):
    assert len(cleaned(spark, "hello", "Hello", "hellò")) == 3


def test_load_report_counts_overlap(spark):
    df = spark.createDataFrame(
        [(1, "a", "same text"), (2, "a", "same text"), (3, "b", "same text "), (4, "b", None), (5, "b", " "), (6, "b", " ")],
        "row_id bigint, source string, text string",
    )
    row = cleaning.load_report(df, row_id="row_id").first()
    assert (row["original_row_count"], row["cleaned_row_count"], row["rows_removed"]) == (6, 1, 5)
    assert (row["duplicate_rows"], row["empty_texts"]) == (2, 3)
    assert row["columns"] == "source,text"


def test_load_report_of_an_empty_table(spark):
    row = cleaning.load_report(texts(spark).filter("row_id > 0")).first()
    assert (row["original_row_count"], row["cleaned_row_count"], row["duplicate_rows"]) == (0, 0, 0)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=list(WHITESPACE) + list("ab​é\x00"), max_size=12), min_size=1, max_size=30))
def test_strip_equals_python(spark, values):
    got = texts(spark, *values).select("row_id", strip("text").alias("s")).orderBy("row_id").collect()
    assert [r["s"] for r in got] == [v.strip() for v in values]


def test_results_do_not_depend_on_partitioning(spark):
    rng = random.Random(7)
    values = [rng.choice(["alpha one", "beta two ", " beta two", "gamma", "xy", None]) for _ in range(300)]
    df = texts(spark, *values)
    expected = sorted(map(tuple, cleaning.clean_texts(df).collect()))
    for n in (1, 7, 40):
        assert sorted(map(tuple, cleaning.clean_texts(df.orderBy(F.rand(n)).repartition(n)).collect())) == expected


def test_many_keys_are_shuffled_and_hashed(spark, monkeypatch):
    df = texts(spark, *[f"answer {i % 50} " for i in range(200)])
    few = sorted(map(tuple, cleaning.clean_texts(df).collect()))
    monkeypatch.setattr(cleaning, "broadcast_if_small", lambda keys, otherwise: keys.hint(otherwise))
    many = cleaning.clean_texts(df)
    assert sorted(map(tuple, many.collect())) == few and len(few) == 50
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_broadcast_only_below_the_limit(spark):
    from themeloom.functions.storage import broadcast_if_small

    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(broadcast_if_small(spark.range(10), 10 * 24))
    assert "broadcast" not in plan(broadcast_if_small(spark.range(11), 10 * 24))


def test_dense_index_spans_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("k"), (-F.col("id")).alias("j")).repartition(11)
        rows = dense_index(df.select("j", "k"), ["k", "j"]).orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["idx"] for r in rows] == list(range(3000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
