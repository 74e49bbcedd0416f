"""Assigning texts to batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.ordering import dense_index
from themeloom.options import (
    BASE_PROMPT_TOKENS,
    BATCH_SIZE,
    MAX_BATCH_TOKENS,
    OVERHEAD_PER_ENTRY,
    TARGET_BATCH_TOKENS,
)


def fixed_batches(indexed: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Add ``batch_id`` and ``pos`` (place in the batch) to a table with a dense ``idx``."""
    return indexed.withColumn("batch_id", F.floor(F.col("idx") / size).cast("bigint")).withColumn(
        "pos", (F.col("idx") % size).cast("int")
    )


def packed_batches(
    counted: DataFrame,
    row_id: str = "row_id",
    max_tokens: int = MAX_BATCH_TOKENS,
    target_tokens: int = TARGET_BATCH_TOKENS,
    base_tokens: int = BASE_PROMPT_TOKENS,
    overhead: int = OVERHEAD_PER_ENTRY,
) -> DataFrame:
    """Greedy packing of texts by rising token count: ``row_id``, ``n_tokens``, ``batch_id``.

    A batch closes before a text that would pass ``max_tokens`` and after it reaches
    ``target_tokens``; a text over the limit is alone.

    Texts of equal count are interchangeable, so runs of one count can be cut into batches by
    arithmetic. A text that reaches the target by itself is always the last of its batch, so
    from the second such text on each is alone and needs only its position. What is left to fold
    is the histogram of the smaller counts: at most ``target_tokens`` rows whatever the data.
    """
    ranked = dense_index(counted.select("n_tokens", row_id), ["n_tokens", row_id], "_rank")
    small_limit = max(target_tokens - base_tokens - overhead, 0)
    small = F.col("n_tokens") < small_limit

    histogram = ranked.filter(small).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens")
    runs, tail_start, tail_batch, room = _cut_runs(
        ((r["n_tokens"], r["n"]) for r in histogram.collect()),
        max_tokens,
        target_tokens,
        base_tokens,
        overhead,
    )
    spark = counted.sparkSession
    segments = (
        spark.createDataFrame(runs, "n_tokens bigint, start bigint, size bigint, first_batch bigint")
        .groupBy("n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("start", "size", "first_batch"))).alias("_runs"))
    )
    run = F.element_at(F.filter("_runs", lambda s: s["start"] <= F.col("_rank")), -1)
    packed = (
        ranked.filter(small)
        .join(F.broadcast(segments), "n_tokens")
        .withColumn("_run", run)
        .select(
            row_id,
            "n_tokens",
            (
                F.col("_run.first_batch")
                + F.floor((F.col("_rank") - F.col("_run.start")) / F.col("_run.size"))
            )
            .cast("bigint")
            .alias("batch_id"),
        )
    )
    # The first large text joins the batch left open if it fits; all later ones move up by one.
    opener = ranked.filter(~small & (F.col("_rank") == tail_start)).select("n_tokens").take(1)
    joins_open = bool(opener) and room is not None and opener[0]["n_tokens"] + overhead <= room
    first_alone = tail_batch if joins_open or room is None else tail_batch + 1
    alone = ranked.filter(~small).select(
        row_id, "n_tokens", (F.col("_rank") - tail_start + first_alone).cast("bigint").alias("batch_id")
    )
    return packed.unionByName(alone)


def _cut_runs(
    histogram: Iterable[tuple[int, int]], max_tokens: int, target: int, base: int, overhead: int
) -> tuple[list[tuple[int, int, int, int]], int, int, int | None]:
    """Cut each run of equal counts into stretches of equally filled batches.

    Returns the stretches (count, first rank, texts per batch, first batch), the next rank, the
    batch that is open or would be next, and the room left in it (None if nothing is open).
    """
    runs: list[tuple[int, int, int, int]] = []
    rank = batch = 0
    used, held = base, 0
    for tokens, left in histogram:
        cost = tokens + overhead
        while left:
            to_target = 0 if used >= target else -(-(target - used) // cost) if cost > 0 else left
            fitting = (max_tokens - used) // cost if cost > 0 else left
            if fitting <= 0 and held:
                batch, used, held = batch + 1, base, 0
                continue
            take = max(min(max(to_target, 1), fitting), 1)
            if not held and left >= take:
                full = left // take
                runs.append((tokens, rank, take, batch))
                rank, left = rank + full * take, left - full * take
                closes = base + take * cost >= target
                batch += full if closes else full - 1
                used, held = (base, 0) if closes else (base + take * cost, take)
            else:
                take = min(take, left)
                runs.append((tokens, rank, take, batch))
                rank, left = rank + take, left - take
                used, held = used + take * cost, held + take
                if used >= target:
                    batch, used, held = batch + 1, base, 0
    return runs, rank, batch, (max_tokens - used if held else None)
