"""Fixing intermediate tables on shared storage, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A broadcast table may hold this many bytes of cells.
BROADCAST_BYTES = 32 << 20
# Bytes counted for a cell of fixed width, and for each element of an array or map.
_CELL = 8


def use_checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stages: the one the session names in ``spark.checkpoint.dir``.

    Only a session in one JVM without that setting gets a temporary folder, as in tests.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="themeloom-")
    context.setCheckpointDir(folder)
    return folder


def stage_folder(spark: SparkSession) -> str:
    """The folder below the checkpoint folder that holds this application's stages."""
    return f"{use_checkpoint_folder(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet on shared storage and read it from there.

    Later reads prune columns and filter row groups, see the table's real size, and survive a lost
    executor. The files stay until :func:`clear_stages`.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Remove all stages of this application. Tables that still read them fail afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def freeze(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it on shared storage, so that a lost executor loses nothing.

    Rows come back in the partitions and order they were written in, which :func:`stage` does not
    promise.
    """
    use_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def has_more_than(df: DataFrame, n: int) -> bool:
    """Whether a stored table has more than ``n`` rows. A plain count sends one row per task."""
    return df.count() > n


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the cells of ``df`` hold, from one aggregate over all its rows."""

    def cell(field: T.StructField):
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            return F.octet_length(F.array_join(field.name, " "))
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            return F.size(field.name) * _CELL
        return F.lit(_CELL)

    each = sum((F.coalesce(cell(f).cast("bigint"), F.lit(0)) + _CELL for f in df.schema.fields), F.lit(_CELL))
    return df.agg(F.coalesce(F.sum(each), F.lit(0))).head()[0]


def broadcast_if_small(stored: DataFrame, max_bytes: int = BROADCAST_BYTES, otherwise: str | None = None) -> DataFrame:
    """Hint a broadcast of a stored table after measuring it.

    A larger one is shuffled, with the join hint ``otherwise`` if given and as the optimizer sees fit
    if not; adaptive execution then splits partitions of hot keys.
    """
    if table_bytes(stored) <= max_bytes:
        return F.broadcast(stored)
    return stored.hint(otherwise) if otherwise else stored
