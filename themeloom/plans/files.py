"""A run from a file of answers to folders of results."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.storage import stage
from themeloom.operators import cleaning, hierarchy, reports, similar, themes
from themeloom.options import Options
from themeloom.plans import analysis
from themeloom.sources import files, sinks


def run_metadata(run: analysis.Analysis, options: Options, input_path: str = "") -> DataFrame:
    """One row about a run: input and its bytes, text column, settings as JSON, and the load report as a struct."""
    report = cleaning.load_report(run.source, options.text_column, options.row_id, options.min_text_length, options.drop_duplicates)
    return report.select(
        F.lit(input_path).alias("input"),
        F.lit(files.total_bytes(run.source.sparkSession, input_path) if input_path else None).cast("bigint").alias("input_bytes"),
        F.lit(options.text_column).alias("text_column"),
        F.lit(json.dumps(asdict(options), sort_keys=True)).alias("settings"),
        F.struct(*report.columns).alias("load_report"),
    )


def analyze_file(
    spark: SparkSession,
    path: str,
    out: str,
    ask: analysis.Ask,
    text: str,
    options: Options = Options(),
    cache: DataFrame | None = None,
    as_of: Column | None = None,
    merges: DataFrame | None = None,
    embeddings: DataFrame | analysis.Embed | None = None,
    edges: DataFrame | None = None,
    **reading,
) -> analysis.Analysis:
    """Read the answers in ``path``, analyse the column ``text`` and write below ``out``:

    ``results``, ``theme_counts``, ``summary`` (the metrics of the summary sheet) and ``theme_quality`` (CSV), ``statistics``
    (JSON lines by section), ``analysis_summary`` and ``run`` (JSON, see
    :func:`run_metadata`) and ``responses`` (Parquet, the cache of the next run); with ``edges`` (``parent, child``) also
    ``hierarchy`` (CSV). ``merges`` and ``embeddings`` are those of :func:`themeloom.plans.analysis.analyze`. ``reading`` goes to
    :func:`themeloom.sources.files.read_answers`. The folders must not exist.
    """
    options = replace(options, text_column=text)
    answers = files.read_answers(spark, path, text, row_id=options.row_id, **reading)
    run = analysis.analyze(answers, ask, options, cache, as_of, merges=merges, embeddings=embeddings)
    sinks.write_table(analysis.result_table(run, options), f"{out}/results", "csv")
    counts = reports.theme_count_tables(run.results)
    sinks.write_table(counts.select("stage", "theme", "n"), f"{out}/theme_counts", "csv")
    stats = themes.theme_stats(themes.theme_occurrences(run.results, "consolidated"))
    sinks.write_json_documents(reports.statistics_json(run.results, run.batches, stats, as_of), f"{out}/statistics")
    sinks.write_table(reports.summary_metrics(run.results, run.batches).coalesce(1).orderBy("position"), f"{out}/summary", "csv")
    occ = themes.occurrences(run.results, "merged")
    merged = stage(themes.theme_stats(occ))
    sinks.write_table(similar.theme_quality(merged), f"{out}/theme_quality", "csv")
    folded = themes.themes_merged(themes.theme_stats(themes.occurrences(run.results)))
    sinks.write_table(reports.analysis_summary(run.results, run.batches, themes.register(occ), folded), f"{out}/analysis_summary", "json")
    if edges is not None:
        sinks.write_table(hierarchy.hierarchy_counts(occ, edges), f"{out}/hierarchy", "csv")
    sinks.write_table(run_metadata(run, options, path), f"{out}/run", "json")
    sinks.write_table(run.responses, f"{out}/responses")
    return run
