"""Theme counts, spelling variants, mappings and limits.

``entries`` are wide rows per text with arrays of (theme, confidence); ``occurrences`` are their
long form ``row_id, pos, theme, confidence``; ``stats`` has one row per distinct theme. What is
decided per text stays inside the row. What is decided per theme starts from ``stats``, the
occurrences reduced before the shuffle, so that a very common theme costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.ordering import dense_index
from themeloom.functions.storage import broadcast_if_small, has_more_than, stage
from themeloom.functions.text import col, names, strip
from themeloom.options import (
    HIGH_CONFIDENCE,
    KNOWN_THEMES,
    MAX_EXAMPLES,
    MAX_THEMES_PER_TEXT,
    MIN_CONFIDENCE,
    NA_THEME,
)


def occurrences(entries: DataFrame, source: str = "original") -> DataFrame:
    """The long form of an array of (theme, confidence)."""
    return exploded(entries, source, "row_id").select("row_id", "pos", "_entry.theme", "_entry.confidence")


def theme_occurrences(entries: DataFrame, source: str = "themes") -> DataFrame:
    """The long form of an array of names: ``row_id, pos, theme``."""
    return exploded(entries, source, "row_id").select("row_id", "pos", F.col("_entry").alias("theme"))


def exploded(df: DataFrame, source: Column | str, *keep: str) -> DataFrame:
    """The elements of an array as rows ``pos, _entry``; null elements and empty arrays give none.

    From a plain explode Spark derives a filter on the size of the array, which evaluates the
    expression behind it a second time for every row; the outer form has no such filter.
    """
    return df.select(*keep, F.posexplode_outer(source).alias("pos", "_entry")).filter(F.col("_entry").isNotNull())


# Places of themes in a text are below this.
_PLACES = 1 << 32


def first_sighting() -> Column:
    """The smallest (row_id, pos) as one number, which Spark keeps in a hash aggregate."""
    return F.min(F.col("row_id").cast("decimal(20,0)") * F.lit(_PLACES) + F.col("pos"))


def sighted(first: str = "_first") -> list[Column]:
    """``first_row, first_pos`` of a :func:`first_sighting`."""
    pos = F.pmod(F.col(first), F.lit(_PLACES))
    row = F.floor((F.col(first) - pos) / F.lit(_PLACES)).cast("bigint")
    return [row.alias("first_row"), pos.cast("int").alias("first_pos")]


def theme_stats(occ: DataFrame) -> DataFrame:
    """Per theme: ``n``, mean ``confidence`` if known, and where it was first seen.

    A text may hold a theme more than once; the first place counts.
    """
    measures = [F.count(F.lit(1)).alias("n")]
    if "confidence" in occ.columns:
        measures.append(F.sum("confidence").alias("confidence_sum"))
        measures.append(F.avg("confidence").alias("confidence"))
    seen = occ.groupBy("theme").agg(*measures, first_sighting().alias("_first"))
    return seen.select(*[c for c in seen.columns if c != "_first"], *sighted())


def register(occ: DataFrame) -> DataFrame:
    """Theme registry: names stripped, blanks ignored, case folded onto the first-seen spelling.

    Returns ``theme, n, confidence, first_row, first_pos``.
    """
    made = _registered(occ)
    return made.select("theme", "n", (F.col("confidence_sum") / F.col("n")).alias("confidence"), "first_row", "first_pos")


def _registered(occ: DataFrame) -> DataFrame:
    """Aggregates of numbers by folded name; the spelling is fetched from where it was first seen, as no two are there."""
    named = occ.withColumn("theme", strip("theme")).filter(F.col("theme") != "")
    seen = named.groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence_sum"), first_sighting().alias("_first"))
    folded = seen.withColumn("folded", F.lower("theme"))
    totals = folded.groupBy("folded").agg(F.sum("n").alias("n"), F.sum("confidence_sum").alias("confidence_sum"), F.min("_first").alias("_first"))
    return totals.join(folded.select("folded", "_first", "theme"), ["folded", "_first"]).select("folded", "theme", "n", "confidence_sum", *sighted())


def run_registry(occ: DataFrame, run: int) -> DataFrame:
    """The registry of one run, to be stored and merged: ``folded, theme, n, confidence_sum, first_run, first_row, first_pos``.

    ``run`` numbers the runs in their order.
    """
    return _registered(occ).withColumn("first_run", F.lit(run).cast("bigint"))


def merge_registries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Two registries of :func:`run_registry` as one: counts add up, and the spelling seen first, by run, row and place, stays.

    No answer of an earlier run is read. Each side has a folded name once, so one join by it is all, without a hot key; and as the order
    is a total one, registries may be merged in any order. ``stored`` that is bucketed by ``folded`` is not shuffled.
    """
    order = ("first_run", "first_row", "first_pos")
    old = stored.select("folded", F.struct(*order, "theme").alias("_old"), F.struct("n", "confidence_sum").alias("_a"))
    add = new.select("folded", F.struct(*order, "theme").alias("_new"), F.struct("n", "confidence_sum").alias("_b"))
    # Null structs are passed over.
    first = F.least("_old", "_new")
    both = old.join(add, "folded", "full").withColumn("_first", first)
    total = lambda c: (F.coalesce(f"_a.{c}", F.lit(0)) + F.coalesce(f"_b.{c}", F.lit(0))).alias(c)
    return both.select("folded", "_first.theme", total("n"), total("confidence_sum"), *[f"_first.{c}" for c in order])


def case_map(stats: DataFrame, mode: str = "running") -> DataFrame:
    """``theme, target`` for all but the first-seen spelling of each case-insensitive group.

    ``running`` gives each later spelling the most frequent of those seen up to it, itself
    included; the first never moves. ``global`` gives every spelling, the first too, the most
    frequent of the group. Ties go to the earlier one. Windows run over distinct spellings only.
    """
    group = Window.partitionBy("_folded").orderBy("first_row", "first_pos")
    frame = {
        "running": group.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        "global": group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    }[mode]
    ranked = stats.select("theme", "n", "first_row", "first_pos", F.lower("theme").alias("_folded")).withColumn(
        "_seq", F.row_number().over(group)
    )
    mapped = ranked.withColumn("target", F.max_by("theme", F.struct("n", -F.col("_seq"))).over(frame))
    moved = F.col("_seq") > 1
    if mode == "global":
        moved = moved | (F.col("target") != F.col("theme"))
    return mapped.filter(moved).select("theme", "target")


def themes_merged(stats: DataFrame) -> DataFrame:
    """How many spellings the case map takes in: distinct themes less distinct folded themes."""
    spellings = stats.groupBy(F.lower("theme").alias("_folded")).agg(F.count(F.lit(1)).alias("_n"))
    return spellings.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("themes_merged"))


def _first_by_theme(pairs: Column) -> Column:
    """Of the entries with the same theme keep the first."""
    kept = F.array_distinct(F.transform(pairs, lambda e: e["theme"]))
    return F.transform(
        kept, lambda theme: F.element_at(F.filter(pairs, lambda e: e["theme"] == theme), 1)
    )


def map_themes(entries: DataFrame, mapping: DataFrame, source: str, name: str) -> DataFrame:
    """Replace the themes of each text through ``theme -> target``; unmapped themes stay.

    Order is kept, targets are distinct, and a target has the confidence of its first source.
    ``mapping`` is unique per theme; it is broadcast if it is small. Of a text only ``row_id``, places and
    names meet the map, and only those it has are put together again by text; the texts' other columns
    move once, to meet them.
    """
    targets = broadcast_if_small(stage(mapping.select(F.col("theme").alias("_theme"), "target")))
    narrow = exploded(entries, source, "row_id").select("row_id", "pos", F.col("_entry.theme").alias("_theme"))
    found = F.map_from_entries(F.collect_list(F.struct("pos", "target"))).alias("_moved")
    moved = narrow.join(targets, "_theme").groupBy("row_id").agg(found)

    def mapped(entry: Column, pos: Column) -> Column:
        target = F.try_element_at("_moved", pos)
        return F.struct(F.coalesce(target, entry["theme"]).alias("theme"), entry["confidence"].alias("confidence"))

    return entries.join(moved, "row_id", "left").select(
        "row_id",
        *[c for c in entries.columns if c != "row_id"],
        _first_by_theme(F.transform(F.coalesce(F.col(source), F.array()), mapped)).alias(name),
    )


def entry_themes(entries: DataFrame, mapping: DataFrame, max_themes: int = MAX_THEMES_PER_TEXT) -> DataFrame:
    """Apply the case map: ``merged`` holds all themes with confidences, ``themes`` the first names."""
    return map_themes(entries, mapping, "original", "merged").withColumn(
        "themes", F.slice(names("merged"), 1, max_themes)
    )


def remapped(entries: DataFrame, mapping: DataFrame, max_themes: int = MAX_THEMES_PER_TEXT) -> DataFrame:
    """Replace the ``merged`` themes of each text through one more map, and ``themes``, their first names, with them."""
    moved = map_themes(entries, mapping, "merged", "_moved")
    return moved.withColumn("merged", F.col("_moved")).withColumn("themes", F.slice(names("merged"), 1, max_themes)).select(*entries.columns)


def average_confidence(pairs: Column | str = "merged") -> Column:
    """Mean confidence of a text's themes, 1.0 if it has none."""
    confidences = F.transform(col(pairs), lambda e: e["confidence"])
    total = F.aggregate(confidences, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(col(pairs)) > 0, total / F.size(col(pairs))).otherwise(F.lit(1.0))


def limit_themes(pairs: Column | str, max_themes: int, min_confidence: float = MIN_CONFIDENCE) -> Column:
    """Keep the ``max_themes`` most confident themes of at least ``min_confidence``.

    If that leaves room and a theme was dropped, ``NA`` with confidence 0 takes the next place.
    """
    numbered = F.transform(
        col(pairs),
        lambda e, i: F.struct((-e["confidence"]).alias("_down"), i.alias("_pos"), e["theme"].alias("theme"), e["confidence"].alias("confidence")),
    )
    sure = F.filter(F.sort_array(numbered), lambda e: e["confidence"] >= min_confidence)
    kept = F.slice(
        F.transform(sure, lambda e: F.struct(e["theme"].alias("theme"), e["confidence"].alias("confidence"))), 1, max_themes
    )
    na = F.array(F.struct(F.lit(NA_THEME).alias("theme"), F.lit(0.0).alias("confidence")))
    room = (F.size(kept) < max_themes) & (F.size(kept) < F.size(col(pairs)))
    return F.when(room, F.concat(kept, na)).otherwise(kept)


def high_confidence(pairs: Column | str, themes: Column | str | None = None, threshold: float = HIGH_CONFIDENCE) -> Column:
    """Names of the themes at or above ``threshold``; only those among ``themes`` if given."""
    sure = F.transform(F.filter(col(pairs), lambda e: e["confidence"] >= threshold), lambda e: e["theme"])
    return sure if themes is None else F.array_intersect(col(themes), sure)


def distinct_themes(stats: DataFrame) -> DataFrame:
    """Distinct themes without ``NA`` in first-seen order: ``theme, seq`` from 0, and the count ``n``."""
    order = ["first_row", "first_pos"]
    return dense_index(
        stats.filter(F.col("theme") != NA_THEME).select(*order, "theme", "n"), order, "seq"
    ).select("theme", "seq", "n")


def needs_consolidation(themes: DataFrame, final_count: int) -> bool:
    """Whether there are more than ``final_count`` themes."""
    return has_more_than(themes, final_count)


def consolidated(entries: DataFrame, mapping: DataFrame | None, name: str = "consolidated") -> DataFrame:
    """Map each text's ``themes`` to the consolidated ones; without a mapping copy them.

    Unmapped themes stay, except ``NA``; targets are distinct and in order.
    """
    if mapping is None:
        return entries.withColumn(name, F.col("themes"))
    pairs = F.filter(
        F.transform("themes", lambda t: F.struct(t.alias("theme"), F.lit(1.0).alias("confidence"))),
        lambda e: e["theme"] != NA_THEME,
    )
    mapped = map_themes(entries.withColumn("_source", pairs), mapping, "_source", "_mapped")
    return mapped.select(*entries.columns, names("_mapped").alias(name))


def sorted_themes(stats: DataFrame, k: int | None = None) -> DataFrame:
    """Themes by frequency, ties by first sighting; with ``k`` a distributed top-k."""
    ordered = stats.orderBy(F.desc("n"), "first_row", "first_pos")
    return ordered if k is None else ordered.limit(k)


def valid_merges(stats: DataFrame, merges: DataFrame) -> DataFrame:
    """The rows of ``merges`` (``from_theme, to_theme``) whose themes both exist and differ, each ``from_theme`` once.

    Of several targets for a theme the first by name counts.
    """
    known = stats.select("theme")
    return (
        merges.filter(F.col("from_theme") != F.col("to_theme"))
        .join(known.withColumnRenamed("theme", "from_theme"), "from_theme", "left_semi")
        .join(known.withColumnRenamed("theme", "to_theme"), "to_theme", "left_semi")
        .groupBy("from_theme")
        .agg(F.min("to_theme").alias("to_theme"))
    )


def merge_themes(stats: DataFrame, merges: DataFrame) -> DataFrame:
    """Merge ``from_theme`` into ``to_theme``: counts and confidences add up and the former goes.

    A merge takes place only if both themes exist and differ; each theme is merged once at most.
    """
    valid = valid_merges(stats, merges)
    relabelled = stats.join(
        valid.select(F.col("from_theme").alias("theme"), "to_theme"), "theme", "left"
    ).withColumn("_own", F.col("to_theme").isNull())
    first = F.struct("first_row", "first_pos")
    return (
        relabelled.groupBy(F.coalesce("to_theme", "theme").alias("theme"))
        .agg(
            F.sum("n").alias("n"),
            (F.sum("confidence_sum") / F.sum("n")).alias("confidence"),
            # The surviving theme keeps its own place in the order.
            F.coalesce(F.min(F.when(F.col("_own"), first)), F.min(first)).alias("_first"),
        )
        .select("theme", "n", "confidence", "_first.first_row", "_first.first_pos")
    )


def merge_outcome(stats: DataFrame, merges: DataFrame) -> DataFrame:
    """``from_theme, to_theme, merged``: whether each requested merge takes place."""
    known = stats.select(F.col("theme").alias("_known"))
    has = merges.join(known, F.col("from_theme") == F.col("_known"), "left").withColumn("_from", F.col("_known").isNotNull()).drop("_known")
    both = has.join(known, F.col("to_theme") == F.col("_known"), "left")
    return both.select(
        "from_theme",
        "to_theme",
        (F.col("_from") & F.col("_known").isNotNull() & (F.col("from_theme") != F.col("to_theme"))).alias("merged"),
    )


def theme_totals(stats: DataFrame) -> DataFrame:
    """Distinct themes and occurrences in one row."""
    return stats.agg(
        F.count(F.lit(1)).alias("unique_themes"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_occurrences"),
    )


def approximate_theme_totals(occ: DataFrame, rsd: float = 0.01) -> DataFrame:
    """As :func:`theme_totals` from the occurrences, with the distinct count estimated to within
    ``rsd``: a fixed-size sketch per task instead of a shuffle of themes."""
    return occ.agg(
        F.approx_count_distinct("theme", rsd).alias("unique_themes"), F.count(F.lit(1)).alias("total_occurrences")
    )


def theme_lookup(stats: DataFrame, themes: DataFrame) -> DataFrame:
    """Count and mean confidence of the asked-for themes, 0 for unknown ones."""
    return themes.join(stats.select("theme", "n", "confidence"), "theme", "left").select(
        "theme",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def example_rows(occ: DataFrame, k: int = MAX_EXAMPLES, stats: DataFrame | None = None) -> DataFrame:
    """The first ``k`` texts of each theme by id, with the total: ``theme, rank, row_id, total``.

    Every task passes on no more than ``k`` rows per theme. With the theme counts ``stats`` (``theme, n``) at hand the
    occurrences are read once.
    """
    order = Window.partitionBy("theme").orderBy("row_id")
    pairs = occ.select("theme", "row_id")
    first = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    totals = pairs.groupBy("theme").agg(F.count(F.lit(1)).alias("total")) if stats is None else stats.select("theme", F.col("n").alias("total"))
    return first.join(totals, "theme").select("theme", F.col("rank").cast("bigint").alias("rank"), "row_id", "total")


def theme_examples(
    occ: DataFrame, texts: DataFrame, text: str = "text", k: int = MAX_EXAMPLES, row_id: str = "row_id", stats: DataFrame | None = None
) -> DataFrame:
    """The first ``k`` texts of each theme with the total: ``theme, rank, row_id, text, total``.

    Texts are fetched for the chosen rows, and are not moved if those are few.
    """
    chosen = broadcast_if_small(stage(example_rows(occ, k, stats)))
    wanted = texts.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    return wanted.join(chosen, "row_id").select("theme", "rank", "row_id", "text", "total")


def known_themes(registry: DataFrame, k: int = KNOWN_THEMES) -> DataFrame:
    """The first ``k`` registered themes, as a hint for the requests of a later run. Takes a registry of one run or of many."""
    order = [c for c in ("first_run", "first_row", "first_pos") if c in registry.columns]
    return registry.orderBy(*order).limit(k)
