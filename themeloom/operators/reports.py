"""Result tables and reports.

``results`` has one row per text: ``row_id, batch_id, status, summary, original, merged, themes,
consolidated``; ``batches`` has ``batch_id, n_texts, start_ts, end_ts, tokens_used, api_calls,
errors``. Texts of failed batches (``status = 'error'``) are kept in the result table and left out
of the statistics.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.rows import side_by_side
from themeloom.functions.text import names
from themeloom.operators.themes import average_confidence, exploded, first_sighting, sighted, sorted_themes, theme_occurrences, theme_stats
from themeloom.options import BATCH_SIZE, NA_THEME


def _per(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def _seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / 1_000_000


def answered(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") != "error")


def result_table(source: DataFrame, results: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The input columns with summary, theme lists, counts and confidence next to them."""
    listed = [c for c in ("processing_timestamp",) if c in results.columns]
    named = F.filter("themes", lambda t: t != NA_THEME)
    columns = results.select(
        F.col("row_id").alias(row_id),
        "summary",
        F.array_join("themes", ", ").alias("themes"),
        F.array_join(names("original"), ", ").alias("original_themes"),
        F.array_join("consolidated", ", ").alias("consolidated_themes"),
        F.size("themes").cast("bigint").alias("theme_count"),
        F.size("original").cast("bigint").alias("original_theme_count"),
        F.size("consolidated").cast("bigint").alias("consolidated_theme_count"),
        average_confidence("merged").alias("average_confidence"),
        (F.size("original") - F.size(named)).cast("bigint").alias("themes_filtered"),
        *listed,
    )
    return source.join(columns, row_id, "left")


def batch_stats(results: DataFrame, batches: DataFrame) -> DataFrame:
    """Per batch: entries, duration, mean confidence of its entries, share of entries with a theme."""
    per_batch = (
        answered(results)
        .groupBy("batch_id")
        .agg(
            F.count(F.lit(1)).alias("n_entries"),
            F.avg(average_confidence("merged")).alias("average_confidence"),
            F.avg((F.size("themes") > 0).cast("double")).alias("success_rate"),
        )
    )
    return batches.join(per_batch, "batch_id", "left").select(
        "batch_id",
        F.coalesce("n_entries", F.lit(0)).cast("bigint").alias("n_entries"),
        _seconds(F.col("start_ts"), F.col("end_ts")).alias("duration_seconds"),
        "tokens_used",
        "api_calls",
        F.size("errors").cast("bigint").alias("n_errors"),
        F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"),
        F.coalesce("success_rate", F.lit(0.0)).alias("success_rate"),
    )


def session_stats(results: DataFrame, batches: DataFrame) -> DataFrame:
    """The whole run in one row."""
    entries = answered(results)
    per_entry = entries.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.coalesce(F.sum(F.size("themes")), F.lit(0)).alias("_themes"),
        F.coalesce(F.sum(average_confidence("merged")), F.lit(0.0)).alias("_confidence"),
    )
    distinct = theme_occurrences(entries).agg(F.countDistinct("theme").alias("unique_themes"))
    per_batch = batches.agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("total_tokens_used"),
        F.coalesce(F.sum("api_calls"), F.lit(0)).cast("bigint").alias("total_api_calls"),
        _seconds(F.min("start_ts"), F.max("end_ts")).alias("session_duration"),
    )
    n, b = F.col("total_entries"), F.col("total_batches")
    return side_by_side(per_entry, distinct, per_batch).select(
        "total_batches",
        "total_entries",
        "total_tokens_used",
        "total_api_calls",
        "session_duration",
        _per(n, b).alias("average_batch_size"),
        _per(F.col("total_tokens_used"), n).alias("tokens_per_entry"),
        "unique_themes",
        _per(F.col("_themes"), n).alias("average_themes_per_entry"),
        _per(F.col("_confidence"), n).alias("overall_confidence"),
    )


def processing_stats(batches: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Batches, texts, failures and times in one row; rates are over all batches, failed ones too."""
    ok = F.size("errors") == 0
    total = F.count(F.lit(1))
    time = F.coalesce(F.sum(_seconds(F.col("start_ts"), F.col("end_ts"))), F.lit(0.0))
    return batches.agg(
        total.alias("total_batches"),
        F.coalesce(F.sum(F.when(ok, F.col("n_texts"))), F.lit(0)).cast("bigint").alias("total_texts_processed"),
        F.count_if(~ok).alias("failed_batches"),
        _per(F.count_if(ok), total).alias("success_rate"),
        time.alias("total_processing_time"),
        _per(time, total).alias("average_time_per_batch"),
        F.lit(batch_size).cast("bigint").alias("batch_size"),
    )


def theme_count_tables(results: DataFrame) -> DataFrame:
    """Counts per theme for the themes and for the consolidated themes: ``stage, theme, n`` and the
    first sighting, which breaks ties. ``NA`` is left out."""
    stages = [("original", "themes"), ("consolidated", "consolidated")]
    both = F.array(*[F.struct(F.lit(stage).alias("stage"), F.col(source).alias("names")) for stage, source in stages])
    per_stage = answered(results).select("row_id", F.explode(both).alias("_stage")).select("row_id", "_stage.*")
    occ = exploded(per_stage, "names", "row_id", "stage").select(
        "row_id", "stage", "pos", F.col("_entry").alias("theme")
    )
    occ = occ.filter(F.col("theme") != NA_THEME)
    counted = occ.groupBy("stage", "theme").agg(F.count(F.lit(1)).alias("n"), first_sighting().alias("_first"))
    return counted.select("stage", "theme", "n", *sighted())


def top_theme_counts(counts: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent themes of each stage, as charted."""
    per_stage = [
        sorted_themes(counts.filter(F.col("stage") == stage), k) for stage in ("original", "consolidated")
    ]
    return per_stage[0].unionByName(per_stage[1])


def summary_metrics(
    results: DataFrame,
    batches: DataFrame,
    batch_size: int = BATCH_SIZE,
    prompts: Mapping[str, str] | None = None,
) -> DataFrame:
    """The summary sheet as ``position, metric, value``.

    Batch sizes are listed as "size x batches"; the size of every batch is in :func:`batch_stats`.
    """
    counts = theme_count_tables(results)
    best = F.max(F.struct("n", -F.col("first_row"), -F.col("first_pos"), "theme"))
    per_stage = counts.groupBy().pivot("stage", ["original", "consolidated"]).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"),
        F.count(F.lit(1)).alias("unique"),
        best.alias("best"),
    )
    entries = answered(results).agg(F.count(F.lit(1)).alias("entries"))
    sizes = (
        answered(results)
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("n_texts"))
        .join(batches.select("batch_id"), "batch_id", "right")
        .groupBy(F.coalesce("n_texts", F.lit(0)).alias("size"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("_sizes"))
        .select(F.array_join(F.transform("_sizes", lambda s: F.concat(s["size"], F.lit(" x "), s["n"])), ", ").alias("sizes"))
    )
    totals = batches.agg(
        F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("tokens")
    )
    row = side_by_side(per_stage, entries, sizes, totals)
    row = row.select(
        "*",
        *[F.coalesce(F.col(f"{s}_{m}"), F.lit(0)).alias(f"{s}_{m}_n") for s in ("original", "consolidated") for m in ("occurrences", "unique")],
    )

    def number(c: Column) -> Column:
        return c.cast("bigint").cast("string")

    def ratio(c: Column) -> Column:
        return F.format_string("%.6f", _per(c, F.col("entries")).cast("double"))

    def most_common(stage: str) -> Column:
        found = F.col(f"{stage}_best")
        return F.when(found.isNull(), F.lit("None (0)")).otherwise(
            F.concat(found["theme"], F.lit(" ("), found["n"].cast("string"), F.lit(")"))
        )

    def rounded(total: Column, places: int) -> Column:
        mean = F.bround((total / F.col("batches")).cast("double"), places)
        return F.when((F.col("batches") > 0) & (total > 0), F.format_string(f"%.{places}f", mean)).otherwise(F.lit("N/A"))

    original, final = F.col("original_unique_n"), F.col("consolidated_unique_n")
    # The names of the metrics and the words for a missing one.
    metrics = [
        ("Total Entries Processed", number(F.col("entries"))),
        ("Total Original Theme Occurrences", number(F.col("original_occurrences_n"))),
        ("Unique Original Themes", number(original)),
        ("Most Common Original Theme", most_common("original")),
        ("Total Consolidated Theme Occurrences", number(F.col("consolidated_occurrences_n"))),
        ("Unique Consolidated Themes", number(final)),
        ("Most Common Consolidated Theme", most_common("consolidated")),
        ("Average Themes per Entry (Original)", ratio(F.col("original_occurrences_n"))),
        ("Average Themes per Entry (Consolidated)", ratio(F.col("consolidated_occurrences_n"))),
        (
            "Theme Consolidation Ratio",
            F.when(final > 0, F.concat(number(original), F.lit(" → "), number(final))).otherwise(F.lit("Not applied")),
        ),
        ("Total Tokens Used", number(F.col("tokens"))),
        ("Total Batches Processed", number(F.col("batches"))),
        ("Average Tokens per Batch", rounded(F.col("tokens"), 0)),
        ("Configured Batch Size", F.lit(str(batch_size))),
        ("Actual Average Batch Size", rounded(F.col("entries"), 1)),
        ("Batch Sizes", F.when(F.col("batches") > 0, F.col("sizes")).otherwise(F.lit("N/A"))),
    ]
    metrics += [(name, F.lit(prompt.replace("\n", " | "))) for name, prompt in (prompts or {}).items()]
    table = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), value.alias("value"))
                for i, (name, value) in enumerate(metrics, 1)
            ]
        )
    )
    return row.select(table.alias("_m")).select("_m.*")


def report_statistics(results: DataFrame, batches: DataFrame, stats: DataFrame) -> DataFrame:
    """The five figures of the report in one row. ``stats`` are the theme counts reported on."""
    themes = stats.agg(F.count(F.lit(1)).alias("_unique"))
    return side_by_side(session_stats(results, batches), themes).select(
        "total_entries",
        F.col("_unique").alias("unique_themes"),
        F.col("session_duration").alias("processing_time_seconds"),
        "average_themes_per_entry",
        "overall_confidence",
    )


def theme_report(results: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Theme frequencies of the consolidated themes, most frequent first, and the five figures."""
    stats = theme_stats(theme_occurrences(answered(results), "consolidated"))
    return sorted_themes(stats).select("theme", F.col("n").alias("frequency")), report_statistics(
        results, batches, stats
    )


def analysis_summary(results: DataFrame, batches: DataFrame, stats: DataFrame, merged: DataFrame, k: int = 10) -> DataFrame:
    """Session, theme and processing statistics and the top themes as structs in one row.

    ``stats`` is the theme registry, ``merged`` the one row of
    :func:`themeloom.operators.themes.themes_merged`.
    """
    session = session_stats(results, batches)
    processing = processing_stats(batches)
    top = sorted_themes(stats, k).agg(
        F.transform(
            F.sort_array(
                F.collect_list(F.struct((-F.col("n")).alias("_down"), "first_row", "first_pos", "theme", "n"))
            ),
            lambda t: F.struct(t["theme"].alias("name"), t["n"].alias("frequency")),
        ).alias("top_themes")
    )
    totals = side_by_side(
        stats.agg(F.count(F.lit(1)).alias("unique_themes"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_occurrences")),
        merged,
    ).select(
        F.struct(
            F.col("total_occurrences").alias("total_themes_processed"),
            "unique_themes",
            "themes_merged",
            "total_occurrences",
        ).alias("theme_stats")
    )
    return side_by_side(
        session.select(F.struct(*session.columns).alias("session_stats")),
        totals,
        processing.select(F.struct(*processing.columns).alias("processing_stats")),
        top,
    )


def statistics_json(results: DataFrame, batches: DataFrame, stats: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """The statistics document as lines ``section, json``.

    One line for the summary, one for the ten most frequent themes, and one per theme for the
    frequencies, so that a long theme list stays distributed.
    """
    summary = report_statistics(results, batches, stats)
    stamp = [] if generated_at is None else [generated_at.alias("generated_timestamp")]
    head = summary.select(
        F.lit("analysis_summary").alias("section"), F.to_json(F.struct(*summary.columns, *stamp)).alias("json")
    )
    top = sorted_themes(stats, 10).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_down"), "first_row", "first_pos", "theme", "n"))).alias("_top")
    )
    ranked = top.select(
        F.lit("top_10_themes").alias("section"),
        F.to_json(F.transform("_top", lambda t: F.struct(t["theme"].alias("theme"), t["n"].alias("frequency")))).alias("json"),
    )
    each = stats.select(
        F.lit("theme_frequencies").alias("section"),
        F.to_json(F.struct("theme", F.col("n").alias("frequency"))).alias("json"),
    )
    return head.unionByName(ranked).unionByName(each)


def result_documents(results: DataFrame, texts: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """Each result as a nested document: ``row_id, batch_id, pos, document``."""
    original_text = texts.select(F.col(row_id).alias("row_id"), F.col(text).alias("original_text"))
    stamp = [c for c in ("processing_timestamp",) if c in results.columns]
    document = F.struct(
        "original_text",
        "summary",
        "themes",
        F.map_from_entries("merged").alias("theme_confidences"),
        names("original").alias("original_themes"),
        F.map_from_entries("original").alias("original_theme_confidences"),
        F.col("consolidated").alias("consolidated_themes"),
        *stamp,
    )
    return results.join(original_text, "row_id").select("row_id", "batch_id", "pos", document.alias("document"))


def result_json(results: DataFrame, texts: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """Each result as JSON: ``row_id, batch_id, pos, json``."""
    return result_documents(results, texts, text, row_id).withColumn("json", F.to_json("document")).drop("document")


def result_variants(results: DataFrame, texts: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """Each result as a VARIANT: ``row_id, batch_id, pos, document``. Its fields are read by path, whatever else it holds."""
    return result_documents(results, texts, text, row_id).withColumn("document", F.to_variant_object("document"))


def batch_documents(documents: DataFrame, results: DataFrame, batches: DataFrame) -> DataFrame:
    """Each batch as a nested document around the :func:`result_documents` of its texts, no more than a batch holds:
    ``batch_id, document``."""
    nested = documents.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "document")), _by_pos).alias("_docs"))
    themes = (
        exploded(answered(results), "themes", "batch_id")
        .groupBy("batch_id", F.col("_entry").alias("theme"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("batch_id")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("theme", "n")))).alias("themes_summary"))
    )
    spans = batches.select("batch_id", F.col("start_ts").alias("processing_start"), F.col("end_ts").alias("processing_end"), "errors")
    document = F.struct(
        F.transform("_docs", lambda d: d["document"]).alias("results"),
        "processing_start",
        "processing_end",
        F.col("duration_seconds").alias("processing_duration"),
        "tokens_used",
        "api_calls",
        "errors",
        "themes_summary",
        "average_confidence",
        "success_rate",
    )
    return (
        batch_stats(results, batches)
        .join(spans, "batch_id")
        .join(themes, "batch_id", "left")
        .join(nested, "batch_id", "left")
        .select("batch_id", document.alias("document"))
    )


def batch_json(documents: DataFrame, results: DataFrame, batches: DataFrame) -> DataFrame:
    """Each of the :func:`batch_documents` as JSON: ``batch_id, json``."""
    return batch_documents(documents, results, batches).select("batch_id", F.to_json("document").alias("json"))


def batch_variants(documents: DataFrame, results: DataFrame, batches: DataFrame) -> DataFrame:
    """Each of the :func:`batch_documents` as a VARIANT: ``batch_id, document``."""
    return batch_documents(documents, results, batches).select("batch_id", F.to_variant_object("document").alias("document"))


def _by_pos(a: Column, b: Column) -> Column:
    # Documents hold maps, which have no order of their own.
    return a["pos"] - b["pos"]
