"""Alike embeddings by banded signatures of random hyperplanes: the mode for very many vectors.

A vector's signature says on which side of each of a number of random planes through the origin it lies.
Two vectors at the angle w lie on the same side of a plane with probability 1 - w / pi, so bits in bands, of
which one has to agree, find a pair at the threshold with a probability that can be set. What is found
is verified, so links are exact; pairs are missed at the stated rate. Where the exact search
prunes little, as in many dimensions without clusters, this one compares far less.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.shipping import ship
from themeloom.functions.storage import broadcast_if_small, stage
from themeloom.operators.semantic import compared, distinct_vectors, unit_vectors
from themeloom.options import SIMILARITY_THRESHOLD

# The probability that a pair at the threshold is found; those more alike are found more surely.
RECALL = 0.95
SEED = 42
_MOST_BITS = 30
# Vectors compared in the time it takes to deal one to a band.
_COMPARED_A_MOVE = 64
# Numbers held at a time where signatures are made, and cells of pairs that are compared at a time.
_CELLS = 1 << 21
# Vectors that a task signs and compares, and how many of them meet as many queries at a time.
_TASK = 2048
_TILE = 1024
# Bytes of the queries that go to every task at a time.
_BLOCK_BYTES = 64 << 20
# Bands compared before pairs that share one are set aside.
_STRIDE = 128



def bands(threshold: float, bits: int, recall: float = RECALL) -> int:
    """How many bands of ``bits`` it takes for a pair at the threshold to share one with probability ``recall``."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log1p(-same))


def layout(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """``bits, bands`` of the least work for ``n`` vectors: dealing each to its bands and comparing within buckets of vectors
    that are not alike."""
    bits = min(range(1, _MOST_BITS + 1), key=lambda bits: _work(n, bits, bands(threshold, bits, recall)))
    return bits, bands(threshold, bits, recall)


def _work(n: int, bits: int, n_bands: int) -> float:
    return n_bands * (1 + n / 2**bits / _COMPARED_A_MOVE)


def dealing(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """:func:`layout`, or no bits and one band, which is a single bucket, where the bands would be more work than that.

    So they are at a low threshold or a recall near one: with 0.999999 at 0.4, a vector would be copied to some 1,400 bands.
    """
    bits, n_bands = layout(n, threshold, recall)
    return (0, 1) if _work(n, 0, 1) <= _work(n, bits, n_bands) else (bits, n_bands)


def _planes(dims: int, bits: int, n_bands: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, n_bands * bits))


def _planes_of(vectors: DataFrame, bits: int, n_bands: int, seed: int) -> np.ndarray:
    sample = vectors.select(F.size("vector").alias("n")).head()
    return _planes(sample["n"] if sample else 1, bits, n_bands, seed)


def _signing(planes: np.ndarray, bits: int, n_bands: int):
    """A function of a frame with ``vector``: its slices, each with its vectors and for each band the number its bits make."""
    # Sums of different powers of two under 2^53 are exact as doubles.
    weights = 2.0 ** np.arange(bits)
    rows = max(1, _CELLS // (n_bands * max(bits, 1)))

    def slices(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        for at in range(0, len(frame), rows):
            part = frame.iloc[at : at + rows]
            vectors = np.stack(part["vector"].to_numpy())
            sides = (vectors @ planes > 0).astype(np.float64).reshape(len(part), n_bands, bits)
            yield part, vectors, (sides @ weights).astype(np.int64)

    return slices


def signed(vectors: DataFrame, bits: int, n_bands: int, seed: int = SEED) -> DataFrame:
    """``vectors`` (``id, vector``) with ``keys``: for each band its number above and its bits below."""
    slices = _signing(_planes_of(vectors, bits, n_bands, seed), bits, n_bands)
    offsets = np.arange(n_bands, dtype=np.int64) << bits

    def sign(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, _, numbers in slices(frame):
                yield part.assign(keys=list(numbers + offsets))

    return vectors.select("id", "vector").mapInPandas(sign, "id long, vector array<double>, keys array<long>")


def _number(bits: int) -> np.dtype:
    """The narrowest type for a band's number."""
    return np.dtype("<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4")


def _sealed(vectors: DataFrame, planes: np.ndarray, bits: int, n_bands: int) -> DataFrame:
    """``id, vector, keys`` of a stored table as bytes: doubles, and for each band the number its bits make as a :func:`_number`."""
    slices = _signing(planes, bits, n_bands)

    def seal(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, vectors, numbers in slices(frame):
                rows = {"vector": [v.tobytes() for v in vectors.astype("<f8")], "keys": [k.tobytes() for k in numbers.astype(_number(bits))]}
                yield part[["id"]].assign(**rows)

    spread = vectors.select("id", "vector").repartition(math.ceil(vectors.count() / _TASK) or 1)
    return spread.mapInPandas(seal, "id long, vector binary, keys binary")


def banded_links(vectors: DataFrame, threshold: float = SIMILARITY_THRESHOLD, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """Links ``a, b`` between ids that pairs with a cosine of at least ``threshold`` connect; of pairs at it, about ``recall`` are found.

    ``vectors`` has a unique ``id`` and an ``embedding``, all of one length; null and zero ones are left out. Not every pair is
    listed. Identical vectors collapse first. Where bands would be more work than to compare all, there is one bucket
    (:func:`dealing`). In each bucket those within half the distance of its first vector are linked to
    that and are not compared with each other, so a crowd of alike vectors costs no square; the others meet all
    in chunks.
    """
    copies, same = distinct_vectors(vectors)
    bits, n_bands = dealing(copies.count(), threshold, recall)
    dealt = stage(signed(copies.select(F.col("b").alias("id"), "vector"), bits, n_bands, seed))
    narrow = dealt.select("id", F.explode("keys").alias("cell"))
    # A bucket of one has nothing to compare.
    buckets = stage(narrow.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1"))
    heads = stage(buckets.select("cell", "first").join(dealt.select(F.col("id").alias("first"), F.col("vector").alias("head")), "first"))
    met = dealt.select("id", "vector", F.explode("keys").alias("cell")).join(broadcast_if_small(heads), "cell")
    cosine = F.aggregate(F.zip_with("vector", "head", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    # Half the distance of the threshold, with the distance between unit vectors as sqrt(2 - 2 cosine).
    near = cosine >= 1 - (1 - threshold) / 4 + 1e-9
    placed = stage(met.select("cell", near.alias("visiting"), "id", "vector", "first"))
    starred = placed.filter(F.col("visiting") & (F.col("id") > F.col("first"))).select(F.col("id").alias("a"), F.col("first").alias("b"))
    return same.unionByName(starred).unionByName(compared(placed, threshold)).distinct()


def recall_of(vectors: DataFrame, threshold: float, queries: DataFrame, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One row ``threshold, pairs, found, recall``: of the pairs of a query and any other vector at or above the threshold, counted
    exactly, how many share a band of the :func:`layout` of :func:`banded_links`.

    ``queries`` are ``id`` s of ``vectors`` and their embeddings go to every task, in blocks of bounded size. Every vector is signed once;
    a block meets the stored vectors and signatures in one pass over them, however few files the input has.
    """
    ship(vectors.sparkSession)
    units = stage(unit_vectors(vectors))
    bits, n_bands = layout(units.count(), threshold, recall)
    planes = _planes_of(units, bits, n_bands, seed)
    asked = stage(units.join(queries.select("id"), "id", "left_semi"))
    dealt, asked = (stage(_sealed(some, planes, bits, n_bands)) for some in (units, asked))
    pairs = found = held = 0
    block: list = []

    def count(block: list) -> tuple[int, int]:
        compare = _counting(block, threshold, bits, n_bands)
        row = dealt.mapInPandas(compare, "n long, shared long").agg(F.sum("n"), F.sum("shared")).head()
        return row[0] or 0, row[1] or 0

    for row in asked.toLocalIterator():
        block.append(row)
        held += len(row["vector"]) + len(row["keys"])
        if held >= _BLOCK_BYTES:
            n, shared = count(block)
            pairs, found, held, block = pairs + n, found + shared, 0, []
    if block:
        n, shared = count(block)
        pairs, found = pairs + n, found + shared
    return vectors.sparkSession.createDataFrame([(threshold, pairs, found, found / pairs if pairs else 1.0)], "threshold double, pairs bigint, found bigint, recall double")


def _unsealed(cells: Iterable[bytes], kind: np.dtype | str, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=kind).reshape(rows, -1)


def _strides(numbers: np.ndarray) -> list[np.ndarray]:
    """A few bands each, rows side by side, so that those of a pair are fetched at once."""
    return [np.ascontiguousarray(numbers[:, at : at + _STRIDE]) for at in range(0, numbers.shape[1], _STRIDE)]


def _counting(block: list, threshold: float, bits: int, n_bands: int):
    """A function of sealed frames: how many of the pairs of the queries of ``block`` and others are alike, and how many of those share a band.

    Products of single precision decide, save for those so near the threshold that their rounding could matter: these are made again from doubles.
    """
    ids = np.array([r["id"] for r in block], dtype=np.int64)
    wanted = _unsealed((r["vector"] for r in block), "<f8", len(block))
    bands_wanted = _strides(_unsealed((r["keys"] for r in block), _number(bits), len(block)))
    # Twice the most that rounding the factors, the products and their sum can change in a product of unit vectors.
    slack = (wanted.shape[1] + 4) * 2.0**-23

    def alike(at: int, x: np.ndarray, x_single: np.ndarray, wanted_single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = (wanted_single[at : at + _TILE] @ x_single.T).ravel()
        places = _set(cosines >= threshold - slack)
        q, v = places // len(x) + at, places % len(x)
        unsure = np.flatnonzero(cosines[places] < threshold + slack)
        wrong = [some[np.einsum("ij,ij->i", wanted[q[some]], x[v[some]]) < threshold] for some in _slices(unsure, wanted.shape[1])]
        sure = np.ones(len(q), dtype=bool)
        for some in wrong:
            sure[some] = False
        return q[sure], v[sure]

    def compare(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = shared = 0
        wanted_single = wanted.astype(np.float32)
        for frame in frames:
            for start in range(0, len(frame), _TILE):
                part = frame.iloc[start : start + _TILE]
                x, others = _unsealed(part["vector"], "<f8", len(part)), part["id"].to_numpy()
                x_single, bands_here = x.astype(np.float32), _strides(_unsealed(part["keys"], _number(bits), len(part)))
                for at in range(0, len(ids), _TILE):
                    q, v = alike(at, x, x_single, wanted_single)
                    other = ids[q] != others[v]
                    q, v = q[other], v[other]
                    n += len(q)
                    shared += sum(_sharing(a, b, bands_wanted, bands_here) for a, b in zip(_slices(q, _STRIDE), _slices(v, _STRIDE)))
        yield pd.DataFrame({"n": [n], "shared": [shared]})

    return compare


def _slices(places: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Slices of ``places`` that make no more than :data:`_CELLS` cells with so many for each."""
    step = max(1, _CELLS // max(width, 1))
    return (places[at : at + step] for at in range(0, len(places), step))


def _set(flags: np.ndarray) -> np.ndarray:
    """The places of the few that are true, looked for eight at a time."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    places = np.flatnonzero(flags[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[places >> 3] * 8 + (places & 7), np.flatnonzero(flags[whole:]) + whole])


def _sharing(q: np.ndarray, v: np.ndarray, wanted: list[np.ndarray], here: list[np.ndarray]) -> int:
    """How many of the pairs ``q, v`` share a band; those that do are not looked at further."""
    pairs = len(q)
    for x, y in zip(wanted, here):
        if not len(q):
            break
        same = _set((x.take(q, axis=0) == y.take(v, axis=0)).ravel()) // x.shape[1]
        apart = np.ones(len(q), dtype=bool)
        apart[same] = False
        q, v = q[apart], v[apart]
    return pairs - len(q)
