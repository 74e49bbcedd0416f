"""Row positions in a total order, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.storage import freeze

# monotonically_increasing_id() puts the partition above bit 33 and the row's place below.
_PLACE_BITS = 33


def dense_index(df: DataFrame, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys``, which must be unique.

    The rows are range-partitioned and sorted once, then frozen: the range bounds are sampled, so
    a second evaluation could place rows differently. A row's position is its place in its
    partition plus the number of rows in the partitions before it. Only that offset table, one
    row per partition, is ordered in one task and broadcast. Pass key columns only; join the
    wide columns back afterwards.
    """
    columns = df.columns
    ordered = freeze(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    placed = ordered.withColumn("_mark", F.monotonically_increasing_id()).select(
        *columns,
        F.shiftright("_mark", _PLACE_BITS).alias("_part"),
        F.col("_mark").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place"),
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *columns, (F.col("_offset") + F.col("_place")).cast("bigint").alias(name)
    )
