"""Exact deduplication through an extendible-hash index kept in shared files.

Every text gets a 64-bit hash. Copies fold to one entry before they are shuffled. A directory over
the leading hash bits doubles until no bucket that can still be split holds more than ``capacity``
entries; entries are written by bucket, so that each owner task holds a range of buckets and sees
all entries of a hash as one chain. An entry says which row stays and how many rows it has; for chains
of more than one row the texts themselves are compared, and an entry that stands for two texts is an error.

Only DataFrame functions are used. Nothing but the directory's histogram, 65,536 counts at most,
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.storage import broadcast_if_small, stage

# Entries a bucket holds before its directory slot is split.
CAPACITY = 1_000_000
# The directory looks at no more than this many leading bits; a fuller bucket chains beyond its capacity.
DIRECTORY_BITS = 16


def normalised(text: Column) -> Column:
    """Runs of white space (space and U+0009 to U+000D) as one space; null as the empty text."""
    # A run that is one space already needs no replacement, and most runs are.
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t-\\r][ \\t-\\r]*| [ \\t-\\r]+", " ")


def directory(counts: dict[int, int], capacity: int, bits: int = DIRECTORY_BITS) -> dict[int, tuple[int, int]]:
    """For each slot of ``bits`` leading bits its bucket: (local depth, prefix).

    Starts with one bucket; while a bucket is overfull, it is split by its next bit, which doubles
    the directory if the bucket is as deep as the directory.
    """
    slots: dict[int, tuple[int, int]] = {}
    todo = [(0, 0, sorted(counts))]
    while todo:
        depth, prefix, members = todo.pop()
        if depth == bits or sum(counts[s] for s in members) <= capacity:
            slots.update(dict.fromkeys(members, (depth, prefix)))
            continue
        below = bits - depth - 1
        for bit in (0, 1):
            half = [s for s in members if s >> below & 1 == bit]
            if half:
                todo.append((depth + 1, prefix << 1 | bit, half))
    return slots


def build_index(spark: SparkSession, keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index over ``keys`` (doc_id, h, sha): one entry per distinct (h, sha), stored by bucket.

    Columns: bucket, depth, h, sha, keep_id (smallest doc_id), n (rows), chain (entries of the same h).
    """
    # Partial aggregation folds the copies each task has read; a hot group costs one row per task.
    entries = stage(keys.groupBy("h", "sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    slot = F.shiftrightunsigned("h", 64 - DIRECTORY_BITS).cast("int")
    histogram = {r["slot"]: r["n"] for r in entries.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}
    found = directory(histogram, capacity)
    # Buckets in the order of their hash ranges.
    order = {b: i for i, b in enumerate(sorted(set(found.values()), key=lambda b: b[1] << (DIRECTORY_BITS - b[0])))}
    rows = [(s, order[b], b[0]) for s, b in sorted(found.items())]
    slots = spark.createDataFrame(rows, "slot int, bucket int, depth int")
    placed = entries.withColumn("slot", slot).join(F.broadcast(slots), "slot").drop("slot")
    owned = placed.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "keep_id")
    index = stage(owned)
    chains = index.groupBy("h").agg(F.count(F.lit(1)).alias("chain"), F.sum("n").alias("rows"))
    return stage(index.join(chains, "h"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """For every row its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after :func:`normalised`; the row with the smallest id stays. Null
    texts count as empty, and are copies of one another. Rows that repeat an id are counted as rows of
    their own; the id is then kept for all of them. Rows without an id belong to the group of their
    text, are dropped if a row with an id has it, and keep null ids otherwise. Other columns are not
    looked at, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    norm = normalised(docs[text_column])
    texts = docs.select(docs[id_column].cast("bigint").alias("doc_id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    keys = stage(texts.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")))
    index = build_index(spark, keys, capacity)
    shared = stage(index.filter(F.col("rows") > 1).select("h").distinct())
    # Rows of a chain are compared byte by byte: grouping by the text itself tells how many texts an entry stands for.
    distinct = texts.join(broadcast_if_small(shared), "h").select("h", "norm").distinct()
    compared = distinct.groupBy("h", F.unhex(F.sha2("norm", 256)).alias("sha")).agg(F.count(F.lit(1)).alias("texts"))
    same_digest = F.when(F.col("texts") > 1, F.raise_error(F.lit("two different texts have the same SHA-256")).cast("bigint"))
    # Entries of hashes with one row stand for that row, which needs no lookup.
    entries = index.filter(F.col("rows") > 1).join(compared, ["h", "sha"], "left")
    groups = entries.select("h", "sha", F.coalesce(same_digest, F.col("keep_id")).alias("keep_id"), "n")
    return keys.join(groups, ["h", "sha"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller id has. Ids must be unique and not null."""
    groups = exact_groups(docs, id_column, text_column, capacity)
    dropped = stage(groups.filter(~F.col("kept")).select(F.col("doc_id").alias(id_column)))
    return docs.join(broadcast_if_small(dropped), id_column, "left_anti")
