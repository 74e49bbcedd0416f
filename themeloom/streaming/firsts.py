"""First copies of texts on a stream, with state keyed by the digest of the text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from themeloom.functions.text import digest
from themeloom.operators.cleaning import usable_texts
from themeloom.options import MIN_TEXT_LENGTH

# Timestamps in the rows that wait in the state keep their microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
_WAITING = "digest string, row_id bigint, time timestamp, row string"


def _one_of_each(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text's copies in a batch of rows the one with the smallest id, at the earliest time of any."""
    for batch in batches:
        earliest = batch.groupby("digest")["time"].transform("min")
        yield batch.assign(time=earliest).sort_values("row_id", kind="stable").drop_duplicates("digest")


def _decide(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the smallest row of a text until its time is past, then let it go and remember that it went."""
    if state.hasTimedOut:
        row = state.get[1]
        # Nothing of the text is kept but that it was seen.
        state.update((None, None, None))
        yield pd.DataFrame({"row": [row]})
        return
    best = state.get if state.exists else None
    if best is not None and best[1] is None:
        return
    due = best[2] if best else None
    for batch in batches:
        for row_id, time, row in zip(batch["row_id"], batch["time"], batch["row"]):
            at = int(time.timestamp() * 1000)
            due = at if due is None else min(due, at)
            if best is None or row_id < best[0]:
                best = (int(row_id), row)
    state.update((best[0], best[1], due))
    # Milliseconds are rounded down; a time-out must lie ahead of the watermark.
    state.setTimeoutTimestamp(max(due + 1, state.getCurrentWatermarkMs() + 1))


def first_copies(answers: DataFrame, lateness: str, time: str, text: str = "text", row_id: str = "row_id", min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Usable texts of a stream, stripped, each text once: the copy with the smallest ``row_id``. All columns stay.

    A text goes on when the latest ``time`` seen is more than ``lateness`` past the first time it was seen;
    until then a copy with a smaller id, from any micro-batch, takes its place, and copies that come later are dropped.
    So the result is that of :func:`themeloom.operators.cleaning.clean_texts` over all rows that come within
    ``lateness`` of their ``time``. Rows that come later than that are dropped, like anything behind a watermark. Columns must be
    ones that JSON can hold. For each text that went on, its digest stays in the state. Copies are reduced to one per batch of rows before
    the shuffle, so that a very common text is no hot spot.
    """
    usable = usable_texts(answers, text, min_length)
    narrow = usable.select(
        F.hex(digest(text)).alias("digest"),
        F.col(row_id).cast("bigint").alias("row_id"),
        F.col(time).cast("timestamp").alias("time"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in answers.columns]), _JSON).alias("row"),
    )
    waiting = narrow.mapInPandas(_one_of_each, _WAITING).withWatermark("time", lateness)
    chosen = waiting.groupBy("digest").applyInPandasWithState(
        _decide, "row string", "row_id bigint, row string, due bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return chosen.select(F.from_json("row", answers.schema, _JSON).alias("_r")).select("_r.*")
