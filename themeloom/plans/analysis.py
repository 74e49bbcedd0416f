"""A whole analysis: clean, batch, ask, parse, consolidate, report."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import stage, stage_folder
from themeloom.operators import batching, cleaning, model, parsing, reports, requests, semantic, themes
from themeloom.options import Options

Ask = model.Ask
Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Analysis:
    """The tables of a finished run; see :mod:`themeloom.operators.reports` for what to make of them."""

    source: DataFrame
    texts: DataFrame
    results: DataFrame
    batches: DataFrame
    responses: DataFrame
    case_map: DataFrame
    merge_map: DataFrame | None
    theme_map: DataFrame | None
    representatives: tuple[str, ...]


def answer(
    requested: DataFrame, ask: Ask, cache: DataFrame | None, as_of: Column, options: Options
) -> DataFrame:
    """Requests with their responses, without the prompts.

    Prompts, which hold the texts, are built once and end at the model; what is frozen for the
    later steps is ids and responses. The model is not asked again if a later step is recomputed, nor
    for what a lost task had heard already (``options.journal``).
    """
    journal = options.journal
    if isinstance(journal, bool):
        # Of its own for every table of requests: another run's model may answer otherwise.
        journal = f"{stage_folder(requested.sparkSession)}/journal-{uuid.uuid4().hex}" if journal else None
    if cache is None:
        looked_up = requested.withColumn("response", F.lit(None).cast("string")).withColumn("hit", F.lit(False))
    else:
        looked_up = model.cache_lookup(requested, cache, as_of, options.cache_days)
    keep = [c for c in looked_up.columns if c not in ("prompt_md5", "prompt", "response", "kind")]
    return stage(model.ask_model(looked_up, ask, keep, options.model_tasks, journal, options.calls))


def consolidate(
    distinct: DataFrame, ask: Ask, options: Options, as_of: Column
) -> tuple[tuple[str, ...], DataFrame | None]:
    """Ask for the final themes and for the mapping of every theme to them.

    One rule for lists of any length: every ``themes_per_consolidation`` themes are a request, and while
    there is more than one, the names from all of them are consolidated again. A name takes an even share
    of the answers of its request with it; the themes of a failed request go on as they are. If a round
    does not shorten the list, or the last request fails, the most frequent names stand in for the
    answer. Only the final names, a handful, reach the driver.
    """
    n = options.final_theme_count
    left, length = distinct, distinct.count()
    while True:
        asked = requests.consolidation_requests(left, n, options.question, options.themes_per_consolidation)
        answered = answer(asked, ask, None, as_of, options)
        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, k: a + F.coalesce(k, F.lit(0)))
        replied = parsing.consolidation_names("response", n)
        share = F.ceil(total / F.size(replied)).cast("bigint")
        named = F.transform(replied, lambda name: F.struct(name.alias("theme"), share.alias("n")))
        whole = F.zip_with("themes", "counts", lambda t, k: F.struct(t.alias("theme"), k.alias("n")))
        good = F.col("error").isNull() & (F.size(replied) > 0)
        rows = stage(answered.select("chunk_id", good.alias("good"), F.posexplode(F.when(good, named).otherwise(whole)).alias("pos", "_t")))
        if length <= options.themes_per_consolidation:
            final = [r["theme"] for r in rows.filter("good").orderBy("pos").select("_t.theme").limit(n).collect()]
            break
        seen = rows.select(F.col("chunk_id").alias("row_id"), "pos", "_t.*").groupBy("theme")
        stats = seen.agg(F.sum("n").alias("n"), themes.first_sighting().alias("_first")).select("theme", "n", *themes.sighted())
        left = stage(themes.distinct_themes(stats))
        shorter = left.count()
        if shorter >= length:
            final = []
            break
        length = shorter
    if not final:
        final = [r["theme"] for r in left.orderBy(F.desc("n"), "seq").limit(n).collect()]
    representatives = tuple(final)

    asked = requests.mapping_requests(distinct, representatives, options.mapping_chunk_size)
    answered = answer(asked, ask, None, as_of, options)
    return representatives, parsing.theme_mapping(answered, representatives)


def merge(
    merged: DataFrame, merges: DataFrame | None, embeddings: DataFrame | Embed | None, options: Options
) -> tuple[DataFrame, DataFrame | None]:
    """Entries after merges by name and by embedding, and both as one map ``theme, target``; None if neither is given."""
    steps = []
    if merges is not None:
        seen = stage(themes.theme_stats(themes.occurrences(merged, "merged")).select("theme"))
        steps.append(themes.valid_merges(seen, merges).toDF("theme", "target"))
        merged = stage(themes.remapped(merged, steps[-1], options.max_themes_per_text))
    if embeddings is not None:
        stats = stage(themes.distinct_themes(themes.theme_stats(themes.occurrences(merged, "merged"))))
        if not isinstance(embeddings, DataFrame):
            embeddings = stage(model.embed_texts(stats.select("theme", F.col("theme").alias("text")), embeddings, "theme"))
        known = stats.select("theme", F.col("seq").alias("id"), "n").join(embeddings.select("theme", "embedding"), "theme")
        targets = semantic.similar_themes(known, options.similarity_threshold)
        steps.append(stage(semantic.theme_map(targets, known.select("id", "theme"))))
        merged = stage(themes.remapped(merged, steps[-1], options.max_themes_per_text))
    if len(steps) < 2:
        return merged, steps[0] if steps else None
    # What was merged by name into a theme that merged by embedding goes with it.
    first, then = steps
    onward = first.join(then.toDF("target", "_next"), "target", "left").select("theme", F.coalesce("_next", "target").alias("target"))
    return merged, onward.unionByName(then)


def analyze(
    source: DataFrame,
    ask: Ask,
    options: Options = Options(),
    cache: DataFrame | None = None,
    as_of: Column | None = None,
    known_themes: DataFrame | None = None,
    merges: DataFrame | None = None,
    embeddings: DataFrame | Embed | None = None,
) -> Analysis:
    """Run an analysis of ``source`` with the model callable ``ask`` (prompt in, reply out).

    ``cache`` is a table of earlier responses, ``known_themes`` a theme table of an earlier run. The
    responses to keep for the next run are in ``Analysis.responses``.

    Between the folding of spellings and the consolidation, themes merge as ``merges`` (``from_theme, to_theme``) says, and
    then those whose ``embeddings`` are alike: a table ``theme, embedding``, or a callable that embeds many names at once.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    text, row_id = options.text_column, options.row_id
    texts = cleaning.clean_texts(source, text, row_id, options.min_text_length, options.drop_duplicates)
    hints = [r["theme"] for r in themes.known_themes(known_themes).collect()] if known_themes is not None else []
    asked = requests.batch_requests(
        batching.fixed_batches(texts, options.batch_size),
        text,
        row_id,
        options.question,
        hints,
        options.max_themes_per_text,
    )
    answered = answer(asked, ask, cache, as_of, options)
    entries = stage(parsing.batch_entries(answered))
    spans = answered.select("batch_id", F.col("started_at").alias("start_ts"), F.col("ended_at").alias("end_ts"))
    usage = stage(model.batch_usage(answered, options.count_cached_calls).join(spans, "batch_id"))

    spelling = themes.case_map(themes.theme_stats(themes.occurrences(entries)), options.case_mode)
    merged = stage(themes.entry_themes(entries, spelling, options.max_themes_per_text))
    merged, merge_map = merge(merged, merges, embeddings, options)
    representatives: tuple[str, ...] = ()
    theme_map = None
    results = themes.consolidated(merged, None) if options.consolidate else merged.withColumn(
        "consolidated", F.array().cast("array<string>")
    )
    if options.consolidate:
        seen = themes.theme_stats(themes.theme_occurrences(merged))
        distinct = stage(themes.distinct_themes(seen))
        if themes.needs_consolidation(distinct, options.final_theme_count):
            representatives, theme_map = consolidate(distinct, ask, options, as_of)
            results = themes.consolidated(merged, theme_map)
    results = stage(results.withColumn("processing_timestamp", as_of))
    responses = answered.filter(~F.col("hit") & F.col("error").isNull()).select(
        "prompt_md5", "response", F.col("ended_at").alias("cached_at")
    )
    return Analysis(source, texts, results, usage, responses, spelling, merge_map, theme_map, representatives)


def registry(analysis: Analysis, run: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """The theme registry of a run, fit to be passed on as ``known_themes``.

    With the number of the ``run`` it is one that can be merged, and with the registry ``stored`` by earlier
    runs it is merged into that.
    """
    occ = themes.occurrences(analysis.results, "merged")
    if run is None:
        return themes.register(occ)
    made = themes.run_registry(occ, run)
    return made if stored is None else themes.merge_registries(stored, made)


def result_table(analysis: Analysis, options: Options = Options()) -> DataFrame:
    """The cleaned input rows with their results."""
    columns = [c for c in analysis.texts.columns if c != "idx"]
    return reports.result_table(analysis.texts.select(*columns), analysis.results, options.row_id)
