"""Token quantiles and theme counts from sketches that are stored with each run and merged.

The exact figures (:func:`themeloom.operators.tokens.token_distribution`, :func:`themeloom.operators.themes.theme_totals`) are the
default. Over many runs they would read every run's texts again; a sketch is a few kilobytes a run, and the sketches of
runs merge into that of all. Counts, sums and extremes are kept beside the sketches and stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.rows import side_by_side

# Size of a quantile sketch, and the binary logarithm of the registers of a count sketch.
QUANTILE_SIZE = 800
COUNT_LOG = 14
QUANTILES = {"median_tokens": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def rank_bound(size: int = QUANTILE_SIZE) -> float:
    """How far the rank of an estimated quantile may be off, as a share of all values, with 99 % confidence."""
    return 2.296 / size**0.9021


def count_bound(log: int = COUNT_LOG) -> float:
    """How far an estimated count may be off, as a share of it: three standard errors."""
    return 3 * 1.04 / 2 ** (log / 2)


def run_sketches(counted: DataFrame, occ: DataFrame, run: int, size: int = QUANTILE_SIZE, log: int = COUNT_LOG) -> DataFrame:
    """One row for a run: ``run``, exact totals, ``token_sketch`` of ``n_tokens`` and ``theme_sketch`` of the distinct themes.

    Every task sends one sketch of each kind on, of bounded size.
    """
    texts = counted.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.min("n_tokens").cast("bigint").alias("min_tokens"),
        F.max("n_tokens").cast("bigint").alias("max_tokens"),
        F.kll_sketch_agg_bigint(F.col("n_tokens").cast("bigint"), size).alias("token_sketch"),
    )
    themes = occ.agg(F.count(F.lit(1)).alias("n_occurrences"), F.hll_sketch_agg("theme", log).alias("theme_sketch"))
    return side_by_side(texts, themes).withColumn("run", F.lit(run))


def merge_sketches(rows: DataFrame, size: int = QUANTILE_SIZE) -> DataFrame:
    """The rows of :func:`run_sketches` as one, without ``run``; rows of merged runs may be merged again."""
    return rows.agg(
        F.sum("n_texts").alias("n_texts"),
        F.sum("total_tokens").alias("total_tokens"),
        F.min("min_tokens").alias("min_tokens"),
        F.max("max_tokens").alias("max_tokens"),
        F.kll_merge_agg_bigint("token_sketch", size).alias("token_sketch"),
        F.sum("n_occurrences").alias("n_occurrences"),
        F.hll_union_agg("theme_sketch").alias("theme_sketch"),
    )


def sketched_distribution(merged: DataFrame) -> DataFrame:
    """The figures of :func:`themeloom.operators.tokens.token_distribution` from a row of sketches, and the number of
    themes. Quantiles are off by at most :func:`rank_bound`, ``unique_themes`` by :func:`count_bound`; the rest is exact."""
    return merged.filter("n_texts > 0").select(
        F.col("n_texts").alias("total_texts"),
        "total_tokens",
        (F.col("total_tokens") / F.col("n_texts")).alias("mean_tokens"),
        "min_tokens",
        "max_tokens",
        *[F.kll_sketch_get_quantile_bigint("token_sketch", F.lit(p)).alias(name) for name, p in QUANTILES.items()],
        F.col("n_occurrences").alias("total_occurrences"),
        F.hll_sketch_estimate("theme_sketch").alias("unique_themes"),
    )


def bounds_check(estimates: DataFrame, histogram: DataFrame, unique_themes: Column, size: int = QUANTILE_SIZE, log: int = COUNT_LOG) -> DataFrame:
    """``measure, estimate, within``: whether each estimate keeps to its bound.

    ``histogram`` (``n_tokens, n``) is the exact one, ``unique_themes`` the exact number. A quantile keeps to it if the ranks
    its value has among all reach to within the bound of the wanted one.
    """
    # One row.
    found = estimates.head()
    if found is None:
        return estimates.sparkSession.createDataFrame([], "measure string, estimate bigint, within boolean")
    slack, total = rank_bound(size), F.sum("n")

    def fits(value: int, p: float) -> Column:
        below = F.sum(F.when(F.col("n_tokens") < value, F.col("n")).otherwise(0))
        up_to = F.sum(F.when(F.col("n_tokens") <= value, F.col("n")).otherwise(0))
        return (below / total - slack <= p) & (up_to / total + slack >= p)

    made = lambda name, within: F.struct(F.lit(name).alias("measure"), F.lit(found[name]).cast("bigint").alias("estimate"), within.alias("within"))
    checks = [made(name, fits(found[name], p)) for name, p in QUANTILES.items()]
    themes = F.abs(found["unique_themes"] - unique_themes) <= unique_themes * count_bound(log)
    return histogram.agg(F.array(*checks, made("unique_themes", themes)).alias("c")).select(F.explode("c").alias("c")).select("c.*")
