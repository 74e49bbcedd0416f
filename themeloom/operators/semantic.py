"""Merging themes whose embeddings are alike.

Themes are linked when the cosine of their embeddings reaches a threshold, and linked themes, also
through others, merge. The search is exact. Vectors are put into cells around a few pivot vectors and
packed, cell by cell, into blocks of bounded size. Blocks are not sent to each other: every two of them
meet where a task reads both from shared storage, so a vector is written once, however many cells there are.
The triangle inequality says which vectors of a block have no neighbour in the other and are not
compared. A task reports no more links than it takes to connect what it found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.storage import broadcast_if_small, has_more_than, stage
from themeloom.options import SIMILARITY_THRESHOLD

# Vectors of a block, and how many of them are compared with another block at a time.
CHUNK = 4096
_SLAB = 512
VECTORS_PER_PIVOT = 5_000
# A list of pivots must fit a task; with more vectors the cells grow instead.
MAX_PIVOTS = 4_096
_SLACK = 1e-9


def unit_vectors(vectors: DataFrame, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """``id, vector`` of length one; null and zero embeddings and those without an id are left out."""
    numbers = F.transform(F.col(embedding), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    # A norm named inside a lambda would be worked out again for each of its numbers.
    norms = F.array_repeat("_norm", F.size("_v"))
    return (
        vectors.select(F.col(key).alias("id"), numbers.alias("_v"))
        .withColumn("_norm", norm)
        .filter((F.col("_norm") > 0) & F.col("id").isNotNull())
        .select("id", F.zip_with("_v", norms, lambda x, n: x / n).alias("vector"))
    )


def similarity_links(
    vectors: DataFrame, threshold: float = SIMILARITY_THRESHOLD, vectors_per_pivot: int = VECTORS_PER_PIVOT
) -> DataFrame:
    """Links ``a, b`` between ids that connect exactly what pairs with cosine >= ``threshold`` would.

    ``vectors`` has a unique ``id`` and ``embedding``. Not every pair is listed. There is a cell for every
    ``vectors_per_pivot`` vectors.
    """
    copies, same = distinct_vectors(vectors)
    radius = float(np.sqrt(max(2 - 2 * threshold, 0.0)))
    n_pivots = int(min(MAX_PIVOTS, max(1, copies.count() // vectors_per_pivot)))
    picked = copies.orderBy(F.xxhash64("b"), "b").limit(n_pivots).select("vector").collect()
    if not picked:
        return same
    pivots = np.array([r["vector"] for r in picked])
    placed = stage(
        copies.select(F.col("b").alias("id"), "vector").mapInPandas(
            _placing(pivots, radius), "home int, core boolean, id long, vector array<double>"
        )
    )
    # All members within half the radius of a pivot are within the radius of each other.
    core = placed.filter("core")
    centre = core.groupBy("home").agg(F.min("id").alias("b"))
    near = core.join(F.broadcast(centre), "home").filter(F.col("id") > F.col("b")).select(F.col("id").alias("a"), "b")
    # At most a row for each pivot: where a cell begins if cells are laid end to end.
    before = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("home").agg(F.count(F.lit(1)).alias("_n"))
    begins = cells.select("home", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    number = F.floor((F.col("_begin") + F.pmod(F.xxhash64("id"), F.col("_n"))) / CHUNK).cast("int")
    rows = placed.join(F.broadcast(begins), "home").select(
        F.lit(0).cast("long").alias("cell"), number.alias("number"), F.lit(False).alias("visiting"), "home", "id", "vector"
    )
    return same.unionByName(near).unionByName(_met(rows, threshold, _neighbours(pivots, radius))).distinct()


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first of each group of identical unit vectors (``b, vector``), and links ``a, b`` of the others to it."""
    units = stage(unit_vectors(vectors))
    copies = stage(units.groupBy("vector").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")))
    repeated = copies.filter("n > 1")
    return copies, units.join(repeated, "vector").filter(F.col("id") > F.col("b")).select(F.col("id").alias("a"), "b")


def compared(placed: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` between vectors of a cell: those at home with each other and with the visiting ones.

    ``placed`` is a stored table ``cell, visiting, id, vector``. Cells of up to :data:`CHUNK` vectors are a group each. Larger ones
    are cut into blocks of about as many, and every two that must meet do so by a cross product of the stored blocks.
    """
    sizes = stage(
        placed.groupBy("cell").agg(F.count_if(~F.col("visiting")).alias("_homes"), F.count(F.lit(1)).alias("_all")).filter("_homes > 0")
    )
    crowded = F.col("_all") > CHUNK
    few = placed.join(broadcast_if_small(sizes.filter(~crowded)), "cell").select("cell", "visiting", "id", "vector")
    links = few.groupBy("cell").applyInPandas(_comparing(threshold), "a long, b long")
    many = sizes.filter(crowded)
    if not has_more_than(many, 0):
        return links
    # Blocks of vectors at home come first, those of visiting ones after them.
    homes = F.ceil(F.col("_homes") / CHUNK)
    visits = F.greatest(F.ceil((F.col("_all") - F.col("_homes")) / CHUNK), F.lit(1))
    hashed = F.xxhash64("id")
    number = F.when(F.col("visiting"), homes + F.pmod(hashed, visits)).otherwise(F.pmod(hashed, homes)).cast("int")
    rows = placed.join(broadcast_if_small(many), "cell").select(
        F.col("cell").cast("long").alias("cell"), number.alias("number"), "visiting", F.lit(0).alias("home"), "id", "vector"
    )
    return links.unionByName(_met(rows, threshold))


_BLOCK = "cell long, number int, visiting boolean, homes binary, ids binary, vectors binary"


def _met(rows: DataFrame, threshold: float, neighbours: Callable | None = None) -> DataFrame:
    """Links ``a, b`` within and between the blocks (``cell``, ``number``) of a cell; those of visiting vectors do not meet each other.

    The stored blocks are read by the tasks of a cross product, each of which reads two parts of the table, so
    nothing is shuffled but each vector once. With ``neighbours`` only vectors that it picks are compared.
    """
    blocks = stage(rows.groupBy("cell", "number").applyInPandas(_packed, _BLOCK))
    left, right = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in ("left", "right"))
    meet = (
        (F.col("left_cell") == F.col("right_cell"))
        & (F.col("left_number") <= F.col("right_number"))
        & ~(F.col("left_visiting") & F.col("right_visiting"))
    )
    if has_more_than(blocks.filter("number > 0"), 0):
        pairs = left.join(right.hint("shuffle_replicate_nl"), meet)
    else:  # a block a cell, which meets itself
        pairs = blocks.select(*[F.col(c).alias(f"{side}_{c}") for side in ("left", "right") for c in blocks.columns]).filter(meet)
    return pairs.mapInPandas(_meeting(threshold, neighbours), "a long, b long")


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """The vectors of a block as one row."""
    first = frame.iloc[0]
    cells = {
        "cell": first["cell"],
        "number": first["number"],
        "visiting": first["visiting"],
        "homes": frame["home"].to_numpy(dtype=np.int32).tobytes(),
        "ids": frame["id"].to_numpy(dtype=np.int64).tobytes(),
        "vectors": np.stack(frame["vector"].to_numpy()).astype(np.float64).tobytes(),
    }
    return pd.DataFrame({c: [v] for c, v in cells.items()})


def _placing(pivots: np.ndarray, radius: float):
    def place(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), _SLAB):
                part = frame.iloc[at : at + _SLAB]
                squared = np.maximum(2 - 2 * np.stack(part["vector"].to_numpy()) @ pivots.T, 0)
                core = np.sqrt(squared.min(axis=1)) <= radius / 2 - _SLACK
                yield part.assign(home=squared.argmin(axis=1), core=core)[["home", "core", "id", "vector"]]

    return place


def _neighbours(pivots: np.ndarray, radius: float):
    """A function of vectors, their homes and other homes: which of the vectors may be within the radius of one at home there."""

    def neighbours(x: np.ndarray, home: np.ndarray, others: np.ndarray) -> np.ndarray:
        homes, which = np.unique(home, return_inverse=True)
        others = np.unique(others)
        between = np.sqrt(np.maximum(2 - 2 * pivots[homes] @ pivots[others].T, 0))
        between[homes[:, None] == others[None, :]] = 0
        picked = np.zeros(len(x), dtype=bool)
        for at in range(0, len(x), _SLAB):
            part, own = x[at : at + _SLAB], home[at : at + _SLAB]
            squared = np.maximum(2 - 2 * part @ pivots[others].T, 0)
            nearest = np.maximum(2 - 2 * (part * pivots[own]).sum(axis=1), 0)
            # Distance to the plane between the home pivot and each other pivot.
            apart = between[which[at : at + _SLAB]]
            gap = (squared - nearest[:, None]) / np.maximum(2 * apart, 1e-300)
            gap[apart == 0] = 0
            picked[at : at + _SLAB] = (gap <= radius + _SLACK).any(axis=1)
        return picked

    return neighbours


class _Linked:
    """The ids a task has seen, and for each the place of one it is connected with, the same for all that are."""

    def __init__(self):
        self.ids = np.empty(0, dtype=np.int64)
        self.root = np.empty(0, dtype=np.int64)

    def add(self, ids: np.ndarray) -> np.ndarray:
        """The places of new ids."""
        places = np.arange(len(self.ids), len(self.ids) + len(ids))
        self.ids, self.root = np.concatenate([self.ids, ids]), np.concatenate([self.root, places])
        return places

    def compare(self, x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, threshold: float) -> None:
        """Connect the vectors ``x`` and ``y``, which are at these places, that are alike."""
        for at in range(0, len(x), _SLAB):
            a, b = np.nonzero(x[at : at + _SLAB] @ y.T >= threshold)
            self._connect(at_x[at + a], at_y[b])

    def _connect(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            root_a, root_b = self.root[a], self.root[b]
            apart = root_a != root_b
            if not apart.any():
                return
            a, b, root_a, root_b = a[apart], b[apart], root_a[apart], root_b[apart]
            np.minimum.at(self.root, np.maximum(root_a, root_b), np.minimum(root_a, root_b))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up

    def links(self) -> pd.DataFrame:
        """Each id with the one that stands for those it is connected with, larger id first."""
        other = self.ids[self.root]
        links = pd.DataFrame({"a": np.maximum(self.ids, other), "b": np.minimum(self.ids, other)})
        return links[links["a"] != links["b"]]


def _meeting(threshold: float, neighbours: Callable | None):
    def meet(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linked, places = _Linked(), {}

        def block(row, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = np.frombuffer(row[f"{side}_ids"], dtype=np.int64)
            key = row[f"{side}_cell"], row[f"{side}_number"]
            if key not in places:
                places[key] = linked.add(ids)
            vectors = np.frombuffer(row[f"{side}_vectors"], dtype=np.float64).reshape(len(ids), -1)
            return places[key], vectors, np.frombuffer(row[f"{side}_homes"], dtype=np.int32)

        for frame in frames:
            for row in frame.to_dict("records"):
                (at_x, x, home_x), (at_y, y, home_y) = block(row, "left"), block(row, "right")
                if neighbours:
                    some_x, some_y = neighbours(x, home_x, home_y), neighbours(y, home_y, home_x)
                    at_x, x, at_y, y = at_x[some_x], x[some_x], at_y[some_y], y[some_y]
                linked.compare(x, at_x, y, at_y, threshold)
        yield linked.links()

    return meet


def _comparing(threshold: float):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        linked = _Linked()
        vectors = np.stack(frame["vector"].to_numpy())
        places = linked.add(frame["id"].to_numpy())
        home = ~frame["visiting"].to_numpy(dtype=bool)
        linked.compare(vectors[home], places[home], vectors, places, threshold)
        return linked.links()

    return compare


def connected_groups(links: DataFrame) -> DataFrame:
    """``id, group`` for every id in ``links`` (``a, b``): the lowest id it is connected with.

    Each round takes the lowest group among neighbours and then the group of the group, which
    halves distances; rounds are frozen, so a lost executor does not replay them.
    """
    both = stage(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    groups = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("group")))
    while True:
        seen = (
            both.join(groups.select(F.col("id").alias("b"), "group"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("group").alias("_lowest"))
        )
        lowered = groups.join(seen, "id").select("id", "group", F.least("group", "_lowest").alias("_low"))
        onward = lowered.select(F.col("id").alias("_low"), F.col("_low").alias("_next"))
        moved = stage(
            lowered.join(onward, "_low", "left").select(
                "id", F.least("_low", F.coalesce("_next", "_low")).alias("group"), F.col("group").alias("_was")
            )
        )
        groups = moved.select("id", "group")
        if not has_more_than(moved.filter(F.col("group") != F.col("_was")), 0):
            return groups


def similar_themes(
    stats: DataFrame, threshold: float = SIMILARITY_THRESHOLD, key: str = "id", embedding: str = "embedding",
    vectors_per_pivot: int = VECTORS_PER_PIVOT, links: Callable[[DataFrame, float], DataFrame] | None = None,
) -> DataFrame:
    """Merge map of alike themes: ``id, target`` where ``target`` is the most frequent theme of its group.

    ``stats`` has a unique numeric ``id``, a count ``n`` and an ``embedding``; ties go to the lower
    id. Themes alike to no other are left out. ``links`` may be another search, such as
    :func:`themeloom.operators.hyperplanes.banded_links`; without one it is the exact :func:`similarity_links`.
    """
    keyed = stats.select(F.col(key).alias("id"), "n", F.col(embedding).alias("embedding"))
    vectors = keyed.select("id", "embedding")
    found = links(vectors, threshold) if links else similarity_links(vectors, threshold, vectors_per_pivot)
    groups = connected_groups(found)
    counted = groups.join(keyed.select("id", "n"), "id")
    best = counted.groupBy("group").agg(F.max_by("id", F.struct("n", -F.col("id"))).alias("target"))
    return counted.join(best, "group").select("id", "target")


def theme_map(targets: DataFrame, names: DataFrame) -> DataFrame:
    """``theme, target`` by name, fit for :func:`themeloom.operators.themes.map_themes`, from ``id, target``
    and the names ``id, theme``. Themes that are their own target are left out."""
    target = names.select(F.col("id").alias("target"), F.col("theme").alias("_name"))
    named = targets.filter(F.col("id") != F.col("target")).join(names.select("id", "theme"), "id").join(target, "target")
    return named.select("theme", F.col("_name").alias("target"))
