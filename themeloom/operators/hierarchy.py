"""Hierarchies of themes of any depth: ancestors, cycles and counts.

Edges are ``parent, child``. Ancestors come from doubling: pairs at most 2^k steps apart, joined with
themselves, give those at most 2^(k+1) apart, so a hierarchy of depth d takes about log2(d) joins. Every
round is staged, and only pairs found in the round before take part in the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import broadcast_if_small, stage


def closure(edges: DataFrame) -> DataFrame:
    """All pairs ``ancestor, descendant`` that a path of one or more edges joins, each once.

    A theme on a cycle is its own ancestor. Edges with a null end are none; an edge from a theme to itself is a
    cycle of one.
    """
    known = stage(
        edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"))
        .filter("ancestor is not null and descendant is not null")
        .distinct()
    )
    new = known
    while True:
        # A path of up to 2^(k+1) steps has a part found in the last round at its head, or one at its tail.
        head = new.join(known.toDF("descendant", "below"), "descendant").select("ancestor", F.col("below").alias("descendant"))
        tail = known.join(new.toDF("descendant", "below"), "descendant").select("ancestor", F.col("below").alias("descendant"))
        found = stage(head.unionByName(tail).distinct().join(known, ["ancestor", "descendant"], "left_anti"))
        if found.isEmpty():
            return known
        known = stage(known.unionByName(found))
        new = found


def cycles(reach: DataFrame) -> DataFrame:
    """Themes on a cycle of a :func:`closure`, as ``theme, cycle``; a cycle is named by its smallest theme."""
    back = reach.select(F.col("descendant").alias("ancestor"), F.col("ancestor").alias("descendant"))
    both = reach.join(back, ["ancestor", "descendant"], "left_semi")
    return both.groupBy(F.col("ancestor").alias("theme")).agg(F.min("descendant").alias("cycle"))


def hierarchy_counts(occ: DataFrame, edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """Per theme of the hierarchy: ``n_own``, ``n_texts``, ``n_below`` and ``cycle``.

    ``n_own`` are the texts with the theme itself, ``n_texts`` those with it or any theme below it, each text once
    however many of them it has, ``n_below`` the themes below it and ``cycle`` the cycle it lies on, if any. Themes of a
    cycle are below each other. ``occ`` has ``row_id, theme``; themes outside the hierarchy do not count.
    Pass a staged :func:`closure` as ``reach`` if there is one.
    """
    reach = closure(edges) if reach is None else reach
    themes = reach.select(F.explode(F.array("ancestor", "descendant")).alias("theme")).distinct()
    # Every theme of the hierarchy with itself, and those below it.
    own = themes.select(F.col("theme").alias("ancestor"), F.col("theme").alias("descendant"), F.lit(True).alias("own"))
    below = reach.filter("ancestor != descendant").withColumn("own", F.lit(False))
    scope = stage(own.unionByName(below))
    seen = occ.select("row_id", F.col("theme").alias("descendant")).join(broadcast_if_small(scope), "descendant")
    texts = seen.groupBy("ancestor", "row_id").agg(F.bool_or("own").alias("own"))
    counts = texts.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("own").alias("n_own"))
    sizes = scope.groupBy("ancestor").agg((F.count(F.lit(1)) - 1).alias("n_below"))
    named = cycles(reach).select(F.col("theme").alias("ancestor"), "cycle")
    return (
        sizes.join(counts, "ancestor", "left")
        .join(named, "ancestor", "left")
        .select(
            F.col("ancestor").alias("theme"),
            F.coalesce("n_own", F.lit(0)).cast("bigint").alias("n_own"),
            F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_texts"),
            F.col("n_below").cast("bigint").alias("n_below"),
            "cycle",
        )
    )
