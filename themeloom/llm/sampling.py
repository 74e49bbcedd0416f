"""Bounded samples by hash, without every task sending its candidates on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOW, _SPAN = -(1 << 63), 1 << 64


def smallest(rows: DataFrame, rank: str, n: int, total: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the smallest 64-bit hashes ``rank``, in order; all of them if there are fewer.

    ``total`` is about how many rows there are. A bound on the hash that about ``2 n`` rows keep to comes
    first, so that what is ordered in one place stays in proportion to ``n`` however many tasks there
    are; it is raised while fewer than ``n`` rows keep to it.
    """
    share = 2 * n / max(total, 1)
    while share < 1:
        some = rows.filter(F.col(rank) < _LOW + int(_SPAN * share))
        if some.count() >= n:
            return some.orderBy(rank, *ties).limit(n)
        share *= 2
    return rows.orderBy(rank, *ties).limit(n)
