"""Writing results. Each sink writes one file per partition, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Columns a delimited file can hold: arrays joined by ", ", other nested values as JSON."""

    def cell(field: T.StructField):
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            return F.array_join(field.name, ", ").alias(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(field.name).alias(field.name)
        return F.col(field.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write as ``parquet``, ``csv`` (UTF-8 with header) or ``json`` lines."""
    if format == "csv":
        options = {"header": True, "escape": '"', "encoding": "UTF-8", "lineSep": "\n"}
        flat(df).write.mode(mode).options(**options).csv(path)
    elif format in ("parquet", "json"):
        df.write.mode(mode).format(format).save(path)
    else:
        raise ValueError(f"no writer for {format}")


def write_json_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ready-made JSON texts (``section, json``) as lines, one folder per section."""
    documents.write.mode(mode).partitionBy("section").text(path)
