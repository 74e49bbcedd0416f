"""Packing into length buckets whose bounds minimise padding.

The global histogram of lengths goes to the driver: lengths up to 512 exactly, longer ones rounded up
to 9 significant bits, so that it has under 8,000 rows however much data there is. Dynamic programming
over it chooses the bucket bounds with the least padding. Inside a bucket documents are numbered in
the order of their ids, by a range sort of ids alone, and cut into batches of a token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import numpy as np

from themeloom.functions.ordering import dense_index
from themeloom.functions.storage import stage

BUCKETS = 12
BATCH_TOKENS = 65_536
_EXACT_BITS = 9


def word_count(text: Column) -> Column:
    """Words between white space (space and U+0009 to U+000D); null is empty."""
    # Ends of words are a character followed by white space or the end of the text.
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]++")).cast("bigint")


def bound_of(length: Column) -> Column:
    """A length rounded up to ``_EXACT_BITS`` significant bits, which is itself if it has no more."""
    bits = F.length(F.bin(length))
    step = F.pow(F.lit(2.0), F.greatest(bits - _EXACT_BITS, F.lit(0))).cast("bigint")
    return (F.floor((length + step - 1) / step) * step).cast("bigint")


def best_bounds(bounds: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets with the least padding.

    ``bounds`` rise; ``rows`` and ``tokens`` say how many documents and tokens each has. The padding of
    a bucket is its bound times its documents, less their tokens. Its cost is such that the best cut
    moves one way as a bucket's end does, so a row of the table is filled by halving.
    """
    n = len(bounds)
    if not n:
        return []
    before = np.concatenate([[0.0], np.cumsum(rows, dtype=float)])
    inside = np.concatenate([[0.0], np.cumsum(tokens, dtype=float)])
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + bounds[j - 1] * (before[j] - before[i]) - (inside[j] - inside[i])
            k = int(np.argmin(total))
            new[j], cut[j] = total[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        # A bucket more never pads more; keeping the old end where it is as good ends early.
        cost = new
        cuts.append(cut)
    found, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        found.append(int(bounds[j - 1]))
        j = int(cut[j])
    return sorted(found)


def histogram(lengths: DataFrame) -> DataFrame:
    """bound, n_docs, n_tokens over the lengths ``n_tokens``."""
    return lengths.groupBy(bound_of(F.col("n_tokens")).alias("bound")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: Column | None = None,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
) -> DataFrame:
    """For every row: doc_id, n_tokens, bucket (its bound), batch (from 0 in its bucket), position (in its batch).

    ``length`` is a bigint expression on ``docs``, by default the words of the text. A batch of a bucket
    holds as many documents as fit into ``batch_tokens`` when padded to the bound; a document longer than
    the budget is a batch of its own. Null and empty texts have length 0 and a bucket padded to 0 (all of
    them in one batch per ``batch_tokens`` documents) if a bound of 0 is chosen, else the shortest bucket.
    Ids order the documents; rows of one id and length are interchangeable, and null ids come first.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    measured = docs.select(
        docs[id_column].cast("bigint").alias("doc_id"),
        F.coalesce(word_count(docs[text_column]) if length is None else length, F.lit(0)).cast("bigint").alias("n_tokens"),
    )
    lengths = stage(measured)
    found = sorted((r["bound"], r["n_docs"], r["n_tokens"]) for r in histogram(lengths).collect())
    ends = best_bounds(*[np.array([r[i] for r in found], np.int64) for i in range(3)], buckets)
    if not ends:
        return spark.createDataFrame([], "doc_id bigint, n_tokens bigint, bucket bigint, batch bigint, position bigint")
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= end, F.lit(end)) for end in ends]).cast("bigint")
    # Positions over (bucket, id): a bucket's start is what the buckets before it hold.
    held = {end: 0 for end in ends}
    for bound, rows, _ in found:
        held[next(e for e in ends if bound <= e)] += rows
    starts, total = {}, 0
    for end in ends:
        starts[end], total = total, total + held[end]
    start = F.coalesce(*[F.when(F.col("bucket") == end, F.lit(s)) for end, s in starts.items()])
    placed = dense_index(lengths.select(bucket.alias("bucket"), "doc_id", "n_tokens"), ["bucket", "doc_id", "n_tokens"])
    size = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest("bucket", F.lit(1))), F.lit(1)).cast("bigint")
    place = F.col("idx") - start
    return placed.select(
        "doc_id",
        "n_tokens",
        "bucket",
        F.floor(place / size).cast("bigint").alias("batch"),
        (place % size).cast("bigint").alias("position"),
    )
