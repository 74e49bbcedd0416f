"""Putting one-row tables together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """The columns of tables of one row each in one row, by a union rather than a join."""
    columns = [c for t in one_row for c in t.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
