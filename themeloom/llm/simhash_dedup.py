"""Near-duplicates by SimHash fingerprints, joined through the anchors of a covering code.

Two fingerprints of 64 bits that differ in at most ``distance`` bits are found so: the bits are cut
into blocks, each with a share of the distance, such that every close pair keeps to the share in one
block at least. In each block the words of a covering code with radius 1 (a Hamming code on the first
bits, all words on the rest) are the anchors. A fingerprint's home is the anchor nearest to it, and it
is replicated to every anchor within radius plus share; a pair that keeps to the share meets at the
home of either. One code over all 64 bits would do without blocks, but has some 130,000 anchors
within radius 1 + 4; with the blocks below there are about 30.

Fingerprints are compared per anchor inside the join, which puts out close pairs only. Equal
fingerprints are folded first, and partitions of hot anchors are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import broadcast_if_small, stage
from themeloom.llm.components import components

# The contract's: words in a shingle, seed of XXH64, bits in which near-duplicates may differ.
SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
# Shingles hashed at a time, which bounds memory for very long texts.
_CHUNK = 1 << 20

_BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


@dataclass(frozen=True)
class Block:
    """Bits ``start`` to ``start + size``; the first ``2**parity - 1`` carry a Hamming code."""

    start: int
    size: int
    share: int
    parity: int


# Shares 1, 1 and 0: if a pair broke all three it would differ in 2 + 2 + 1 bits.
BLOCKS = (Block(0, 21, 1, 4), Block(21, 21, 1, 4), Block(42, 22, 0, 4))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: a bit is 1 if it is in over half the hashes of the word shingles."""
    # Bytes: lower() touches A-Z only, split() the white space of the contract only.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    width = min(shingle, len(words))
    stops = (ends[width - 1 :] - 1).tolist()
    starts = np.concatenate([[0], ends[: len(stops) - 1]]).tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(stops), _CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])]
        hashes = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(hashes[:, k], minlength=256) @ _BYTE_BITS
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(stops)))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint (``fp``, a signed bigint of the same bits) of every text; null is empty."""

    @F.pandas_udf("bigint")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), of(F.col(text_column)).alias("fp"))


def _syndrome_of(pattern: int, coded: int) -> int:
    """The syndrome of a pattern of bits: position numbers (from 1) of its coded bits, xor-ed."""
    found = 0
    for i in range(coded):
        if pattern >> i & 1:
            found ^= i + 1
    return found


def patterns(block: Block, weight: int) -> list[list[int]]:
    """By syndrome, the patterns of at most ``weight`` bits whose flipping leads to an anchor."""
    coded = (1 << block.parity) - 1
    table: list[list[int]] = [[] for _ in range(coded + 1)]
    for w in range(weight + 1):
        for bits in combinations(range(block.size), w):
            pattern = sum(1 << b for b in bits)
            table[_syndrome_of(pattern, coded)].append(pattern)
    return table


def replicas(blocks: tuple[Block, ...] = BLOCKS) -> float:
    """How many anchors a fingerprint is replicated to on average."""
    return sum(sum(comb(b.size, w) for w in range(b.share + 2)) / (1 << b.parity) for b in blocks)


def _anchors(fp: Column, block: Block, reach: int | None) -> Column:
    """The anchors within ``reach`` of a fingerprint in a block as an array, or for None its home."""
    part = F.shiftrightunsigned(fp, block.start).bitwiseAND((1 << block.size) - 1)
    coded = (1 << block.parity) - 1
    syndrome = F.lit(0)
    for j in range(block.parity):
        mask = sum(1 << i for i in range(coded) if (i + 1) >> j & 1)
        syndrome = syndrome + F.shiftleft(F.bit_count(part.bitwiseAND(mask)).bitwiseAND(1), j)
    # The nearest anchor differs in the one coded bit the syndrome names, or in none.
    found = [[p for p in row if p < 1 << coded and p.bit_count() <= 1][:1] for row in patterns(block, 1)] if reach is None else patterns(block, reach)
    table = F.array(*[F.array(*[F.lit(p).cast("bigint") for p in row]) for row in found])
    return F.transform(F.get(table, syndrome), lambda p: part.bitwiseXOR(p))


def _key(fp: Column, blocks: tuple[Block, ...], home: bool) -> Column:
    """One row per anchor; the block's number above bit 56 keeps blocks apart."""
    parts = [_anchors(fp, b, None if home else b.share + 1) for b in blocks]
    tagged = (lambda number: lambda anchor: anchor.bitwiseOR(F.lit(number << 56)))
    return F.explode(F.concat(*[F.transform(p, tagged(i)) for i, p in enumerate(parts)]))


def check_blocks(blocks: tuple[Block, ...], distance: int) -> None:
    """Raise if a close pair could break the share of every block, or if the blocks are no cut."""
    if sum(b.share + 1 for b in blocks) <= distance:
        raise ValueError("the shares are too small for the distance")
    if [b.start for b in blocks] != [sum(b.size for b in blocks[:i]) for i in range(len(blocks))] or sum(b.size for b in blocks) != BITS:
        raise ValueError("the blocks must cut the fingerprint")
    if any((1 << b.parity) - 1 > b.size for b in blocks):
        raise ValueError("a code is longer than its block")


def close_pairs(fps: DataFrame, distance: int = DISTANCE, blocks: tuple[Block, ...] = BLOCKS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints ``fp`` that differ in at most ``distance`` bits; a pair may repeat."""
    check_blocks(blocks, distance)
    homes = fps.select(F.col("fp").alias("a"), _key(F.col("fp"), blocks, home=True).alias("anchor"))
    reached = fps.select(F.col("fp").alias("b"), _key(F.col("fp"), blocks, home=False).alias("anchor"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return homes.join(reached.hint("merge"), "anchor").filter(near).select("a", "b")


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    distance: int = DISTANCE,
    blocks: tuple[Block, ...] = BLOCKS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """For every row: doc_id, fingerprint (16 hex digits), component_id (smallest id it is linked to).

    Fingerprints link at ``distance`` or fewer differing bits, through others too. Null and blank texts
    have fingerprint zero and link like any other. Repeated ids give repeated rows; rows without an id
    take part with their fingerprint and get the component of the others in it, null if all lack ids.
    Other columns are not looked at. An empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, id_column, text_column, shingle))
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(close_pairs(distinct.select("fp"), distance, blocks))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stage(rooted.join(smallest, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their group. Ids must be unique and not null."""
    groups = near_groups(docs, id_column, text_column, **options)
    dropped = stage(groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_column)))
    return docs.join(broadcast_if_small(dropped), id_column, "left_anti")
