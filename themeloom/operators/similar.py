"""Pairs of themes: containment, co-occurrence; hierarchy counts and quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import broadcast_if_small, stage
from themeloom.functions.text import col
from themeloom.operators.themes import exploded
from themeloom.options import MIN_CONFIDENCE

# What a merge suggestion says.
SUGGESTED_SIMILARITY = 0.8
SUGGESTION = "review"


def _grams(c: str, n: int) -> Column:
    count = F.length(c) - (n - 1)
    windows = F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(count > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


# Short themes up to this many are looked for in each text as one list; there are few of one or two letters.
SHORT_THEMES = 4_096


def containment_pairs(themes: DataFrame) -> DataFrame:
    """Pairs ``seq1 < seq2`` of themes (``theme, seq``) where one contains the other, ignoring case.

    A theme can only lie in a theme that has its rarest trigram, so each looks up the themes
    with that one trigram. Lookups carry numbers and trigrams only; the texts of what they find are fetched
    and checked. Themes of one or two characters are looked up by their whole text, and of a theme's pieces of that length only those that are
    such a theme leave its row: the list of them goes to every task if it is at most :data:`SHORT_THEMES` long, and is joined
    if it is longer.
    """
    folded = stage(themes.select("seq", F.lower("theme").alias("text")).filter(F.col("text") != ""))
    postings = stage(exploded(folded, _grams("text", 3), "seq").select("seq", F.col("_entry").alias("gram")))
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = postings.join(counts, "gram").groupBy("seq").agg(F.min(F.struct("n", "gram")).alias("_rarest"))

    def looked_up(inner: DataFrame, outer: DataFrame) -> DataFrame:
        found = inner.join(outer.withColumnRenamed("seq", "_out"), "gram")
        return found.filter(F.col("seq") != F.col("_out")).select(F.col("seq").alias("_in"), "_out")

    candidates = looked_up(rarest.select("seq", "_rarest.gram"), postings)
    short = folded.filter(F.length("text") < 3).select("seq", F.col("text").alias("gram"))
    listed = [r["gram"] for r in short.select("gram").distinct().limit(SHORT_THEMES + 1).collect()]
    if listed:
        pieces = F.concat(_grams("text", 1), _grams("text", 2))
        if len(listed) <= SHORT_THEMES:
            pieces = F.array_intersect(pieces, F.array(*[F.lit(g) for g in listed]))
        held = exploded(folded, pieces, "seq").select("seq", F.col("_entry").alias("gram"))
        candidates = candidates.unionByName(looked_up(broadcast_if_small(stage(short)), held))
    inner = folded.select(F.col("seq").alias("_in"), F.col("text").alias("_inner"))
    outer = folded.select(F.col("seq").alias("_out"), F.col("text").alias("_outer"))
    held = candidates.join(inner, "_in").join(outer, "_out").filter(F.col("_outer").contains(F.col("_inner")))
    # Themes that differ in case only hold each other and are found twice.
    return held.select(F.least("_in", "_out").alias("seq1"), F.greatest("_in", "_out").alias("seq2")).distinct()


def merge_suggestions(themes: DataFrame, k: int | None = 10) -> DataFrame:
    """Containment pairs as suggestions ``theme1, theme2, similarity, recommendation``: the first ``k`` in
    theme order, or all."""
    themes = stage(themes.select("seq", "theme"))
    pairs = containment_pairs(themes)
    if k is not None:
        pairs = pairs.orderBy("seq1", "seq2").limit(k)
    first = themes.select(F.col("seq").alias("seq1"), F.col("theme").alias("theme1"))
    second = themes.select(F.col("seq").alias("seq2"), F.col("theme").alias("theme2"))
    return (
        pairs.join(first, "seq1")
        .join(second, "seq2")
        .select(
            "seq1",
            "seq2",
            "theme1",
            "theme2",
            F.lit(SUGGESTED_SIMILARITY).alias("similarity"),
            F.lit(SUGGESTION).alias("recommendation"),
        )
    )


def cooccurrence(entries: DataFrame, themes: Column | str = "themes") -> DataFrame:
    """Unordered pairs of themes named for the same text: ``n_both``, each theme's ``n``, Jaccard.

    ``themes`` are distinct names, few per text, so pairs are formed inside the row; nothing is
    joined on the text id, and pair counts are reduced before the shuffle.
    """
    named = entries.select(F.sort_array(col(themes)).alias("_names"))
    ahead = F.transform(
        "_names",
        lambda a, i: F.transform(
            F.slice("_names", i + 2, F.size("_names")), lambda b: F.struct(a.alias("theme1"), b.alias("theme2"))
        ),
    )
    pairs = exploded(named, F.flatten(ahead)).select("_entry.*")
    both = pairs.groupBy("theme1", "theme2").agg(F.count(F.lit(1)).alias("n_both"))
    support = exploded(named, "_names").groupBy(F.col("_entry").alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    return (
        both.join(support.select(F.col("theme").alias("theme1"), F.col("n").alias("n1")), "theme1")
        .join(support.select(F.col("theme").alias("theme2"), F.col("n").alias("n2")), "theme2")
        .select(
            "theme1",
            "theme2",
            "n_both",
            "n1",
            "n2",
            (F.col("n_both") / (F.col("n1") + F.col("n2") - F.col("n_both"))).alias("jaccard"),
        )
    )


def hierarchy_rollup(occ: DataFrame, edges: DataFrame) -> DataFrame:
    """Texts per child and per parent theme, ``edges`` being ``parent, child``.

    A text counts once per parent however many of its children it has. Parent rows have a null
    child; the row without parent counts all texts with a theme in the hierarchy.
    """
    return (
        occ.select("row_id", F.col("theme").alias("child"))
        .join(broadcast_if_small(stage(edges.select("parent", "child"))), "child")
        .rollup("parent", "child")
        .agg(F.countDistinct("row_id").alias("n_texts"))
    )


def theme_quality(stats: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per theme: count, mean confidence, number of spellings, and whether to review it."""
    spellings = stats.groupBy(F.lower("theme").alias("_folded")).agg(F.count(F.lit(1)).alias("case_variants"))
    singleton = F.col("n") == 1
    unsure = F.col("confidence") < min_confidence
    return (
        stats.withColumn("_folded", F.lower("theme"))
        .join(spellings, "_folded")
        .select(
            "theme",
            "n",
            "confidence",
            "case_variants",
            singleton.alias("is_singleton"),
            unsure.alias("low_confidence"),
            F.when(singleton | unsure | (F.col("case_variants") > 1), "review").otherwise("ok").alias("status"),
        )
    )
