"""Token counts, their distribution, and cost estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.rows import side_by_side
from themeloom.functions.text import estimate_tokens
from themeloom.options import (
    BASE_PROMPT_TOKENS,
    MAX_BATCH_TOKENS,
    OVERHEAD_PER_ENTRY,
    USD_PER_1K_INPUT,
    USD_PER_1K_OUTPUT,
    USD_PER_1K_TOKENS,
)

TokenCounter = Callable[[Column | str], Column]


def token_counts(df: DataFrame, text: str = "text", count: TokenCounter = estimate_tokens) -> DataFrame:
    """Add ``n_tokens``."""
    return df.withColumn("n_tokens", count(text))


def prompt_token_estimate(
    batches: DataFrame,
    base_prompt: str,
    text: str = "text",
    overhead: int = OVERHEAD_PER_ENTRY,
    count: TokenCounter = estimate_tokens,
) -> DataFrame:
    """Per batch: tokens of its texts, of the base prompt, and an overhead per text."""
    return (
        batches.select("batch_id", count(text).alias("n_tokens"))
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("text_tokens"))
        .select(
            "batch_id",
            "n_texts",
            (F.col("text_tokens") + count(F.lit(base_prompt)) + F.col("n_texts") * overhead).alias(
                "prompt_tokens"
            ),
        )
    )


def batch_size_recommendation(
    counted: DataFrame,
    row_id: str = "row_id",
    max_tokens: int = MAX_BATCH_TOKENS,
    base_tokens: int = BASE_PROMPT_TOKENS,
    overhead: int = OVERHEAD_PER_ENTRY,
    sample: int = 10,
) -> DataFrame:
    """Texts per batch that fit the token limit, judged by the mean of the first ``sample`` texts.

    ``counted`` has ``n_tokens``. The sample is a top-k, not a sort of the table.
    """
    first = counted.select(row_id, "n_tokens").orderBy(row_id).limit(sample)
    mean = first.agg(F.avg("n_tokens").alias("_mean"))
    total = counted.agg(F.count(F.lit(1)).alias("n_texts"))
    per_entry = F.col("_mean") + overhead
    fits = F.floor((max_tokens - base_tokens) / per_entry)
    return side_by_side(mean, total).select(
        "n_texts",
        F.when(F.col("n_texts") == 0, F.lit(0))
        .when(per_entry <= 0, F.lit(1))
        .otherwise(F.greatest(F.lit(1), F.least(fits, F.col("n_texts"))))
        .cast("bigint")
        .alias("batch_size"),
    )


def token_histogram(counted: DataFrame) -> DataFrame:
    """How many texts have each token count; one row per distinct count, whatever the table size."""
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n"))


def token_distribution(counted: DataFrame) -> DataFrame:
    """Count, sum, mean, extremes, median and percentiles of ``n_tokens``; no row for no texts.

    A percentile is the element at position floor(n * p) of the sorted counts. It is read off
    the running sum of the histogram, so the shuffle and the ordered pass see distinct counts
    only and the result is exact.
    """
    running = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    cumulated = token_histogram(counted).select(
        "n_tokens",
        "n",
        F.sum("n").over(running).alias("_up_to"),
        F.sum("n").over(everything).alias("_total"),
    )

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("_up_to") > position, F.col("n_tokens")))

    def percentile(p: float) -> Column:
        return at(F.floor(F.col("_total") * F.lit(p)))

    return cumulated.agg(
        F.sum("n").alias("total_texts"),
        F.sum(F.col("n_tokens") * F.col("n")).alias("total_tokens"),
        (F.sum(F.col("n_tokens") * F.col("n")) / F.sum("n")).alias("mean_tokens"),
        F.min("n_tokens").alias("min_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        at(F.floor(F.col("_total") / 2)).alias("median_tokens"),
        percentile(0.25).alias("p25"),
        percentile(0.75).alias("p75"),
        percentile(0.90).alias("p90"),
        percentile(0.95).alias("p95"),
    ).filter(F.col("total_texts") > 0)


def cost_forecast(
    counted: DataFrame,
    usd_per_1k: float = USD_PER_1K_TOKENS,
    base_tokens: int = BASE_PROMPT_TOKENS,
    overhead: int = OVERHEAD_PER_ENTRY,
    max_tokens: int = MAX_BATCH_TOKENS,
) -> DataFrame:
    """Expected batches, tokens and cost of a table. Costs come unrounded and rounded: Spark
    rounds the printed decimal, so a rounded value may differ from binary rounding at a tie."""
    totals = counted.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("text_tokens"),
    )
    n = F.col("n_texts")
    per_entry = F.when(n > 0, F.col("text_tokens") / n).otherwise(F.lit(0.0)) + overhead
    sized = totals.withColumn("_size", F.greatest(F.lit(1), F.floor(max_tokens / per_entry)))
    counted_out = sized.select(
        "n_texts",
        "text_tokens",
        F.floor((n + F.col("_size") - 1) / F.col("_size")).cast("bigint").alias("estimated_batches"),
        (n * overhead).cast("bigint").alias("overhead_tokens"),
    )
    priced = counted_out.withColumn(
        "prompt_tokens", (F.col("estimated_batches") * base_tokens).cast("bigint")
    ).withColumn("total_tokens", F.col("text_tokens") + F.col("prompt_tokens") + F.col("overhead_tokens"))
    cost = F.col("total_tokens") / 1000 * F.lit(usd_per_1k)
    per_text = F.when(n > 0, cost / n).otherwise(F.lit(0.0))
    return priced.select(
        "total_tokens",
        "text_tokens",
        "prompt_tokens",
        "overhead_tokens",
        "estimated_batches",
        cost.alias("cost_usd"),
        F.round(cost, 4).alias("estimated_cost_usd"),
        F.round(per_text, 6).alias("cost_per_text"),
    )


def usage_cost(
    input_tokens: Column | str,
    output_tokens: Column | str,
    usd_per_1k_input: float = USD_PER_1K_INPUT,
    usd_per_1k_output: float = USD_PER_1K_OUTPUT,
) -> Column:
    """Price of a call, or of summed token counts."""
    paid_in = F.col(input_tokens) if isinstance(input_tokens, str) else input_tokens
    paid_out = F.col(output_tokens) if isinstance(output_tokens, str) else output_tokens
    return paid_in / 1000 * F.lit(usd_per_1k_input) + paid_out / 1000 * F.lit(usd_per_1k_output)
