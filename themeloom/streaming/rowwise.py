"""The steps that look at one row at a time, on a stream of answers or of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame

from themeloom.operators.cleaning import usable_texts
from themeloom.operators.parsing import batch_entries
from themeloom.operators.tokens import token_counts
from themeloom.options import MIN_TEXT_LENGTH


def clean_stream(answers: DataFrame, text: str = "text", min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Usable texts, stripped, with token counts. Copies stay; see
    :func:`themeloom.streaming.firsts.first_copies` for those."""
    return token_counts(usable_texts(answers, text, min_length), text)


def parse_stream(answered: DataFrame) -> DataFrame:
    """Entries with themes from a stream of answered batches."""
    return batch_entries(answered)
