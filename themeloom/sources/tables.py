"""Reading tables of answers that are already in a columnar format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Read a table; filters and column choices reach the scan."""
    return spark.read.format(format).load(path)
