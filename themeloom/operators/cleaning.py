"""Cleaning of the text column and the load report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.ordering import dense_index
from themeloom.functions.storage import broadcast_if_small
from themeloom.functions.text import digest, is_blank, strip
from themeloom.options import MIN_TEXT_LENGTH


def usable_texts(df: DataFrame, text: str = "text", min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Drop null, blank and short texts and strip the rest; the length is taken before stripping.

    Row-wise, so it also accepts a streaming DataFrame.
    """
    kept = df.filter(F.col(text).isNotNull()).filter(~is_blank(text)).filter(F.length(text) >= min_length)
    return kept.withColumn(text, strip(text))


def first_copies(df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """The ``row_id`` of the first row of each distinct text.

    Copies collapse in the map-side aggregate on a 32-byte digest, so a text that makes up a
    third of the rows costs one row per task, and no text is shuffled.
    """
    return (
        df.select(row_id, digest(text).alias("_digest"))
        .groupBy("_digest")
        .agg(F.min(row_id).alias(row_id))
        .select(row_id)
    )


def clean_keys(
    df: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    min_length: int = MIN_TEXT_LENGTH,
    drop_duplicates: bool = True,
) -> DataFrame:
    """``row_id`` and 0-based ``idx`` of the rows that survive cleaning, in ``row_id`` order."""
    usable = usable_texts(df.select(row_id, text), text, min_length)
    keys = first_copies(usable, text, row_id) if drop_duplicates else usable.select(row_id)
    return dense_index(keys, [row_id])


def clean_texts(
    df: DataFrame,
    text: str = "text",
    row_id: str = "row_id",
    min_length: int = MIN_TEXT_LENGTH,
    drop_duplicates: bool = True,
    keys: DataFrame | None = None,
) -> DataFrame:
    """The cleaned table: all input columns, the text stripped, and ``idx`` from 0.

    Wide rows meet the surviving keys, which :func:`clean_keys` gives and which can be passed in to be
    used elsewhere too. Few keys are broadcast and the rows stay where they are. Many are shuffled
    with the rows and hashed, so that the wide rows, some fifty times larger, are not sorted.
    """
    if keys is None:
        keys = clean_keys(df, text, row_id, min_length, drop_duplicates)
    kept = broadcast_if_small(keys, otherwise="shuffle_hash")
    return usable_texts(df, text, min_length).join(kept, row_id).select(*df.columns, "idx")


def load_report(
    df: DataFrame,
    text: str = "text",
    row_id: str | None = None,
    min_length: int = MIN_TEXT_LENGTH,
    drop_duplicates: bool = True,
) -> DataFrame:
    """One row of counts on the raw table: rows, rows left by cleaning, repeated rows, empty texts.

    The counts overlap and need not add up to ``rows_removed``. ``row_id`` is ours, not data, so
    it does not take part in the comparison of whole rows. The table is read once; what is
    shuffled to count distinct texts and rows is their digests.
    """
    data = [c for c in df.columns if c != row_id]
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    usable = F.col(text).isNotNull() & ~is_blank(text) & (F.length(text) >= min_length)
    marked = df.select(
        F.struct(*[digest(c).alias(c) if c in strings else F.col(c) for c in data]).alias("_row"),
        F.when(usable, digest(strip(text))).alias("_kept"),
        (F.col(text).isNull() | is_blank(text)).alias("_empty"),
    )
    original = F.count(F.lit(1))
    cleaned = F.count_distinct("_kept") if drop_duplicates else F.count("_kept")
    return marked.agg(
        original.alias("original_row_count"),
        cleaned.alias("cleaned_row_count"),
        (original - cleaned).alias("rows_removed"),
        (original - F.count_distinct("_row")).alias("duplicate_rows"),
        F.count_if("_empty").alias("empty_texts"),
        F.lit(len(data)).cast("bigint").alias("n_columns"),
        F.lit(",".join(data)).alias("columns"),
        F.lit(text).alias("text_column"),
    )
