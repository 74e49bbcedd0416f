import random

import pytest
from pyspark.sql import functions as F

from themeloom.functions.text import estimate_tokens, token_counter
from themeloom.operators import batching, tokens


def counted(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id bigint, n_tokens bigint")


def pack_one_by_one(values, most=4000, target=3000, base=500, overhead=50):
    """The packing rule, text by text."""
    out, batch, used, held = {}, 0, base, 0
    for row, n in sorted(enumerate(values), key=lambda x: (x[1], x[0])):
        if used + n + overhead > most and held:
            batch, used, held = batch + 1, base, 0
        out[row] = batch
        used, held = used + n + overhead, held + 1
        if used >= target:
            batch, used, held = batch + 1, base, 0
    return out


def packed(spark, values, *limits):
    return {r["row_id"]: r["batch_id"] for r in batching.packed_batches(counted(spark, values), "row_id", *limits).collect()}


def test_token_estimate(spark):
    df = spark.createDataFrame([("",), ("abc",), ("abcd",), ("éèêçàùïô",)], "text string")
    assert [r[0] for r in df.select(estimate_tokens("text")).collect()] == [0, 0, 1, 2]


def test_exact_counter_hook(spark):
    count = token_counter(lambda text: text.split())
    df = spark.createDataFrame([(0, "a b c"), (1, None)], "row_id bigint, text string")
    assert [r["n_tokens"] for r in tokens.token_counts(df, count=count).orderBy("row_id").collect()] == [3, None]


def test_oversized_text_is_alone(spark):
    assert packed(spark, [5000]) == {0: 0}
    assert packed(spark, [10, 5000, 5000, 20]) == {0: 0, 3: 0, 1: 1, 2: 2}


def test_large_text_joins_an_open_batch_if_it_fits(spark):
    assert packed(spark, [100, 2600]) == {0: 0, 1: 0}
    assert packed(spark, [900, 2600]) == {0: 0, 1: 1}
    assert packed(spark, [2600, 2600]) == {0: 0, 1: 1}


@pytest.mark.parametrize("seed", range(12))
def test_packing_equals_the_rule(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([60, 400, 2700, 9000])
    values = [rng.choice([rng.randint(0, top), rng.randint(0, 30), 40]) for _ in range(rng.randint(1, 400))]
    limits = rng.choice([(4000, 3000, 500, 50), (4000, 3000, 500, 0), (1000, 900, 100, 10), (800, 300, 500, 50), (3000, 3000, 0, 1)])
    assert packed(spark, values, *limits) == pack_one_by_one(values, *limits)


def test_packing_of_nothing(spark):
    assert packed(spark, []) == {}


@pytest.mark.parametrize("seed", range(5))
def test_distribution_equals_sorted_indexing(spark, seed):
    rng = random.Random(seed)
    values = [rng.randint(0, 50) for _ in range(rng.randint(1, 120))]
    row = tokens.token_distribution(counted(spark, values)).first()
    s, n = sorted(values), len(values)
    assert row["median_tokens"] == s[n // 2]
    assert [row[f"p{p}"] for p in (25, 75, 90, 95)] == [s[int(n * p)] for p in (0.25, 0.75, 0.90, 0.95)]
    assert (row["total_texts"], row["total_tokens"], row["min_tokens"], row["max_tokens"]) == (n, sum(s), s[0], s[-1])
    assert row["mean_tokens"] == pytest.approx(sum(s) / n)


def test_distribution_of_nothing_has_no_row(spark):
    assert tokens.token_distribution(counted(spark, [])).count() == 0


@pytest.mark.parametrize(
    "values, expected", [([], 0), ([0], 1), ([10] * 3, 3), ([100] * 100, 23), ([10_000] * 5, 1), ([100] * 10 + [9000] * 90, 23)]
)
def test_batch_size_recommendation(spark, values, expected):
    assert tokens.batch_size_recommendation(counted(spark, values)).first()["batch_size"] == expected


def test_cost_forecast(spark):
    row = tokens.cost_forecast(counted(spark, [100, 200, 300])).first()
    assert (row["estimated_batches"], row["total_tokens"]) == (1, 600 + 500 + 150)
    assert row["estimated_cost_usd"] == pytest.approx(0.0125)
    assert row["cost_per_text"] == pytest.approx(0.0125 / 3, abs=1e-6)
    empty = tokens.cost_forecast(counted(spark, [])).first()
    assert (empty["total_tokens"], empty["estimated_batches"], empty["cost_per_text"]) == (0, 0, 0.0)


def test_fixed_batches(spark):
    df = spark.range(60).select(F.col("id").alias("idx"))
    rows = batching.fixed_batches(df).groupBy("batch_id").agg(F.count("*").alias("n"), F.max("pos").alias("p")).orderBy("batch_id")
    assert [tuple(r) for r in rows.collect()] == [(0, 25, 24), (1, 25, 24), (2, 10, 9)]
