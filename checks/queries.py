"""One Spark query per operator, on the given tables. Arrays are flattened so that both engines
can be compared by value."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from themeloom.functions.storage import freeze, stage, stage_folder
from themeloom.functions.text import names
from themeloom.operators import batching, cleaning, hierarchy, hyperplanes, model, parsing, reports, requests, semantic, similar, sketches, themes, tokens
from themeloom.options import Options
from themeloom.plans import analysis
from themeloom.sources import files, sinks
from themeloom.streaming import firsts

Query = Callable[[SparkSession, str], DataFrame]
REPRESENTATIVES = ("Enonon", "Tion", "Ouen", "Der", "Anan")


def _bar(c: Column | str) -> Column:
    return F.array_join(c, "|")


def _r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


def _prompts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "prompt_md5", F.length("prompt").cast("bigint").alias("prompt_length"))


def _counted(spark, d):
    return tokens.token_counts(fx.documents(spark, d))


# Cleaning


def load_report(spark, d):
    return cleaning.load_report(fx.survey(spark, d), row_id="row_id")


def clean_texts(spark, d):
    return cleaning.clean_texts(fx.survey(spark, d)).select(
        "row_id", "idx", "lang", "source", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n_chars")
    )


def streamed_first_copies(spark, d):
    """The survey as a stream of two micro-batches with copies across them; a third, much later row closes it."""
    folder = f"{stage_folder(spark)}/stream-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("row_id") % 3600).alias("at")
    rows = fx.survey(spark, d).select("row_id", "text", "source", at)
    closing = rows.limit(1).select(F.lit(-1).cast("bigint").alias("row_id"), F.lit("closing row").alias("text"), "source", F.timestamp_seconds(F.lit(1735689600)).alias("at"))
    options = {"checkpointLocation": f"{folder}/state", "path": f"{folder}/out"}
    for part in (rows.filter("row_id % 2 = 1"), rows.filter("row_id % 2 = 0"), closing):
        # All files that have come since the last run are a micro-batch, so each may have as many as it needs.
        part.write.mode("append").parquet(f"{folder}/in")
        found = firsts.first_copies(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), "2 hours", "at")
        found.writeStream.options(**options).trigger(availableNow=True).format("parquet").start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").filter("row_id >= 0").select("row_id", "source", F.md5("text").alias("text_md5"))


def clean_conversations(spark, d):
    """The second answer table; its key (conv_id, turn) is folded into one number."""
    turns = fx.table(spark, d, "conversations")
    keyed = turns.withColumn("row_id", F.col("conv_id") * (1 << 31) + F.col("turn"))
    return cleaning.clean_texts(keyed).select("row_id", "idx", "conv_id", "turn", F.md5("text").alias("text_md5"))


# Sources and sinks


def missing_cells(spark, d):
    """The cell rule of delimited files on turns of which some are missing-value tokens."""
    token = F.element_at(F.array(*[F.lit(t) for t in (*files.NA_TOKENS, " NA", "none")]), (F.col("conv_id") % 21 + 1).cast("int"))
    cell = F.when(F.col("turn") % 2 == 1, token).otherwise(F.col("text"))
    turns = fx.table(spark, d, "conversations").select("conv_id", "turn", cell.alias("cell"))
    return turns.select("conv_id", "turn", files.missing_to_null("cell").alias("cell"))


def decoded_texts(spark, d):
    """Documents in French and German as Latin-1 bytes, the others as UTF-8, told apart again."""
    docs = fx.table(spark, d, "documents")
    content = F.when(F.col("lang").isin("fr", "de"), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return docs.select("doc_id", F.md5(files.decoded(content).cast("binary")).alias("text_md5"))


# About how many bytes of text a delimited file gets; one with quoted line breaks is read by one task.
_FILE_BYTES = 64 << 20


def _written(spark, d, sep: str, **options):
    """Documents as delimited files, those in French and German in Latin-1, read back from their bytes."""
    folder = f"{stage_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = fx.table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    docs = docs.repartition(max(4, size // _FILE_BYTES + 1))
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for name, rows, encoding in (("latin", F.col("lang").isin("fr", "de"), "ISO-8859-1"), ("utf8", ~F.col("lang").isin("fr", "de"), "UTF-8")):
        docs.filter(rows).write.options(header=True, sep=sep, escape='"', encoding=encoding, lineSep="\n", **spaces).csv(f"{folder}/{name}")
    read = files.read_delimited(spark, [f"{folder}/latin", f"{folder}/utf8"], sep, text="text", row_id=None, **options)
    return read.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "lang", F.col("n_chars").cast("bigint").alias("n_chars"))


def csv_files(spark, d):
    return _written(spark, d, ",", schema="doc_id bigint, text string, lang string, n_chars bigint")


def tsv_files(spark, d):
    """Tab-separated, with the types taken from the cells."""
    return _written(spark, d, "\t")


def checked_tables(spark, d):
    """Whether tables can be analysed: names and types of their columns, and how many rows have the text at all."""
    asked = (("documents", ["doc_id", "text"], "text"), ("conversations", ["text", "speaker", "mood"], "text"), ("embeddings", ["vec_id"], "embedding"), ("pages", ["url"], "html"))
    rows = []
    for name, required, text in asked:
        table = fx.table(spark, d, name)
        ok, message = files.check_columns(table, required, text)
        rows.append(table.agg(F.lit(name).alias("name"), F.lit(ok).alias("ok"), F.lit(message).alias("message"), F.count(text).alias("n")))
    return reduce(DataFrame.unionByName, rows)


def flat_results(spark, d):
    """Results as a delimited file holds them: arrays joined, other nested values as JSON."""
    results, _ = fx.run(spark, d)
    last = F.element_at(F.transform(names("merged"), lambda t: F.struct(t.alias("theme"))), -1)
    nested = results.filter(F.size("merged") > 0).select("row_id", "themes", "consolidated", last.alias("last"))
    return sinks.flat(nested)


# Tokens and batches


def token_counts(spark, d):
    return _counted(spark, d).select("row_id", "n_tokens")


def token_distribution(spark, d):
    df = tokens.token_distribution(_counted(spark, d))
    return df.withColumn("mean_tokens", F.round("mean_tokens", 6))


def sketched_bounds(spark, d):
    """Three runs, their sketches stored and merged: exact figures, and whether the estimates keep to their bounds."""
    counted, occ = stage(_counted(spark, d).select("row_id", "n_tokens")), stage(fx.occurrences(spark, d).select("row_id", "theme"))
    run = F.col("row_id") % 3
    rows = [stage(sketches.run_sketches(counted.filter(run == k), occ.filter(run == k), k)) for k in range(3)]
    found = stage(sketches.sketched_distribution(sketches.merge_sketches(reduce(DataFrame.unionByName, rows))))
    distinct = occ.agg(F.countDistinct("theme")).head()[0]
    checked = sketches.bounds_check(found, tokens.token_histogram(counted), F.lit(distinct))
    exact = ("total_texts", "total_tokens", "min_tokens", "max_tokens", "total_occurrences")
    figures = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("exact")) for c in exact])).alias("f")).select("f.*")
    return checked.select("measure", F.lit(None).cast("bigint").alias("exact"), "within").unionByName(figures.withColumn("within", F.lit(True)))


def batch_size_recommendation(spark, d):
    return tokens.batch_size_recommendation(_counted(spark, d))


def cost_forecast(spark, d):
    return tokens.cost_forecast(_counted(spark, d)).withColumn("cost_usd", F.round("cost_usd", 6))


def prompt_token_estimate(spark, d):
    return tokens.prompt_token_estimate(fx.batches(spark, d), "Summarise each text and name its themes.")


def usage_cost(spark, d):
    log = fx.request_log(spark, d)
    return log.groupBy("ok").agg(
        F.sum("prompt_tokens").alias("input_tokens"),
        F.sum("response_tokens").alias("output_tokens"),
        _r6(tokens.usage_cost(F.sum("prompt_tokens"), F.sum("response_tokens")), "cost_usd"),
    )


def fixed_batches(spark, d):
    return fx.batches(spark, d).select("row_id", "batch_id", F.col("pos").cast("bigint").alias("pos"))


def packed_batches(spark, d):
    return batching.packed_batches(_counted(spark, d))


# Requests


def batch_requests(spark, d):
    asked = requests.batch_requests(fx.batches(spark, d), question=fx.QUESTION)
    return _prompts(asked, "batch_id", "n_texts")


def hinted_batch_requests(spark, d):
    hints = [r["theme"] for r in themes.known_themes(themes.register(fx.occurrences(spark, d))).collect()]
    return _prompts(requests.batch_requests(fx.batches(spark, d), known_themes=hints), "batch_id", "n_texts")


def _examples(spark, d):
    occ = stage(fx.occurrences(spark, d))
    return themes.theme_examples(occ, fx.documents(spark, d), stats=themes.theme_stats(occ))


def theme_writeup_requests(spark, d):
    return _prompts(requests.theme_writeup_requests(_examples(spark, d)), "theme", "total", "shown")


def quote_requests(spark, d):
    return _prompts(requests.quote_requests(_examples(spark, d)), "theme", "shown")


def _distinct(spark, d):
    return themes.distinct_themes(themes.theme_stats(themes.theme_occurrences(fx.merged_entries(spark, d))))


def _numbered(spark, d):
    return _distinct(spark, d).select("theme", "seq")


def _registered(spark, d):
    return themes.distinct_themes(themes.register(fx.occurrences(spark, d)))


def pair_requests(spark, d):
    return _prompts(requests.pair_requests(similar.merge_suggestions(_registered(spark, d))), "theme1", "theme2")


def mapping_requests(spark, d):
    return _prompts(requests.mapping_requests(_distinct(spark, d), REPRESENTATIVES), "chunk_id")


def consolidation_request(spark, d):
    return _prompts(requests.consolidation_requests(_distinct(spark, d), question=fx.QUESTION), "chunk_id", "n_themes")


# Model boundary


def cache_lookup(spark, d):
    found = model.cache_lookup(fx.cache_requests(spark, d), fx.cache(spark, d), fx.as_of())
    return found.select("request_id", "response", "hit")


def bucketed_cache(spark, d):
    """The lookup against a cache in buckets that was written twice, without a broadcast."""
    folder = f"{stage_folder(spark)}/cache-{uuid.uuid4().hex}"
    writes = fx.cache_writes(spark, d)
    new = F.col("event_type").isin("click", "purchase")
    model.store_cache(model.latest_writes(writes.filter(~new)), f"{folder}/1", 8)
    model.store_cache(model.cache_upsert(model.open_cache(spark, f"{folder}/1"), writes.filter(new)), f"{folder}/2", 8)
    found = model.cache_lookup(fx.cache_requests(spark, d), model.open_cache(spark, f"{folder}/2"), fx.as_of())
    return found.select("request_id", "response", "hit")


def cache_upsert(spark, d):
    return fx.cache(spark, d).select("prompt_md5", "response", F.unix_micros(F.col("cached_at").cast("timestamp")).alias("cached_us"))


def cache_stats(spark, d):
    found = model.cache_lookup(fx.cache_requests(spark, d), fx.cache(spark, d), fx.as_of())
    return model.cache_stats(found).withColumn("hit_rate", F.round("hit_rate", 6))


def cache_expire(spark, d):
    return model.cache_expire(fx.cache_writes(spark, d), fx.as_of())[1]


def usage_stats(spark, d):
    df = model.usage_stats(fx.request_log(spark, d))
    return df.withColumns({c: F.round(c, 6) for c in ("success_rate", "tokens_per_request")})


def embedding_lookup(spark, d):
    found = model.embedding_lookup(
        fx.documents(spark, d), fx.table(spark, d, "embeddings").withColumnRenamed("vec_id", "row_id"), "row_id"
    )
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return found.select(
        "row_id",
        F.col("embedding").isNotNull().alias("found"),
        F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("n_dims"),
        F.round(total, 4).alias("total"),
    )


def model_batch_inference(spark, d):
    """A callable that reports what it was sent and refuses long prompts."""

    def ask(prompt: str) -> str:
        if len(prompt) > 100_000:
            raise ValueError("prompt too long")
        return f"1: {len(prompt)} characters|Length (90%)"

    asked = requests.batch_requests(fx.batches(spark, d), question=fx.QUESTION)
    answered = freeze(model.ask_model(asked, ask, ["batch_id", "n_texts"])).withColumn("hit", F.lit(False))
    usage = model.batch_usage(answered)
    return answered.select("batch_id", "response", "error").join(
        usage.select("batch_id", "tokens_used", "api_calls", _bar("errors").alias("errors")), "batch_id"
    )


def journaled_inference(spark, d):
    """Every second batch is asked first; then all are, by a callable that says otherwise, with the same journal."""

    def ask(prompt: str) -> str:
        if len(prompt) > 100_000:
            raise ValueError("prompt too long")
        return f"1: {len(prompt)} characters|Length (90%)"

    folder = f"{stage_folder(spark)}/journal-{uuid.uuid4().hex}"
    asked = stage(requests.batch_requests(fx.batches(spark, d), question=fx.QUESTION))
    stage(model.ask_model(asked.filter("batch_id % 2 = 0"), ask, ["batch_id"], journal=folder))
    return model.ask_model(asked, lambda prompt: "late", ["batch_id"], journal=folder).select("batch_id", "response", "error")


def calls_by_kind(spark, d):
    """What the callable sees of the kinds of request a run makes."""

    def ask(prompt, call) -> str:
        return f"{call.kind} {call.temperature} {call.max_tokens} {len(prompt)}"

    distinct = stage(_distinct(spark, d))
    made = (
        requests.batch_requests(fx.batches(spark, d), question=fx.QUESTION),
        requests.mapping_requests(distinct, REPRESENTATIVES),
        requests.consolidation_requests(distinct, question=fx.QUESTION),
    )
    every = reduce(DataFrame.unionByName, [df.select("kind", "prompt", "prompt_md5") for df in made])
    return model.ask_model(every, ask).select("prompt_md5", "response")


def batch_usage(spark, d):
    used = model.batch_usage(fx.answered(spark, d))
    return used.select("batch_id", "n_texts", "tokens_used", "api_calls", _bar("errors").alias("errors"))


# Parsing


def _parsed(spark, d):
    return parsing.batch_entries(fx.answered(spark, d))


def parsed_entries(spark, d):
    return _parsed(spark, d).select(
        "row_id", "batch_id", F.col("pos").cast("bigint").alias("pos"), "status", "summary", F.size("original").cast("bigint").alias("n_themes")
    )


def parsed_themes(spark, d):
    occ = themes.occurrences(_parsed(spark, d))
    return occ.select("row_id", F.col("pos").cast("bigint").alias("pos"), "theme", _r6("confidence", "confidence"))


def _list_reply(spark, d):
    """A consolidation reply per source: prose, then each of its themes numbered and, in small letters, with a bullet."""
    occ = fx.occurrences(spark, d).join(fx.documents(spark, d).select("row_id", "source"), "row_id")
    per_source = occ.groupBy("source").agg(F.sort_array(F.collect_set("theme")).alias("_l"))
    lines = F.transform("_l", lambda t, i: F.array(F.concat((i + 1).cast("string"), F.lit(". "), t), F.concat(F.lit("- "), F.lower(t))))
    return per_source.select("source", F.array_join(F.concat(F.array(F.lit("Here they are")), F.flatten(lines)), "\n").alias("response"))


def parsed_consolidation(spark, d):
    return _list_reply(spark, d).select("source", _bar(parsing.consolidation_names("response")).alias("names"))


def _mapping_replies(spark, d):
    """Replies for chunks of themes: exact, partial and unknown targets; a chunk holding a theme in
    capitals fails."""
    chunks = requests.mapping_requests(_distinct(spark, d), REPRESENTATIVES)
    target = lambda t: (
        F.when(t.rlike("^[A-D]"), F.lit("Enonon"))
        .when(t.rlike("^[E-N]"), F.lit("tio"))
        .when(t.rlike("^[O-Z]"), F.lit("the ouen group"))
        .otherwise(F.substring(t, 1, 3))
    )
    said = F.transform("themes", lambda t: F.concat(t, F.lit(" -> "), target(t)))
    failed = F.exists("themes", lambda t: t.rlike("^[A-Z]+$"))
    return chunks.select(
        "chunk_id",
        "themes",
        F.when(~failed, F.array_join(F.concat(F.array(F.lit("Mapping:")), said), "\n")).alias("response"),
        F.when(failed, F.lit("refused")).alias("error"),
    )


def parsed_mapping(spark, d):
    return parsing.theme_mapping(_mapping_replies(spark, d), REPRESENTATIVES)


def parsed_quotes(spark, d):
    """Quotes of replies that cite every line of a turn of a conversation."""
    cited = F.transform(
        F.split("text", "\n"), lambda x, i: F.concat(F.lit("QUOTE "), (i + 1).cast("string"), F.lit(': "'), x, F.lit('"'))
    )
    replies = fx.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(cited, "\n").alias("response"))
    found = replies.select("conv_id", "turn", parsing.quotes("response").alias("_q"))
    return found.select("conv_id", "turn", F.size("_q").cast("bigint").alias("n_quotes"), F.md5(_bar("_q")).alias("quotes_md5"))


def parsed_verdicts(spark, d):
    """Verdict replies made from events: the answer's label, its case and the confidence vary."""
    e = fx.table(spark, d, "events")
    reply = F.concat(
        F.when(F.col("event_type") == "click", F.lit("Answer: Yes")).when(F.col("event_type") == "view", F.lit("Similar: yes, mostly")).otherwise(F.lit("Answer: No")),
        F.lit("\n  Confidence: "),
        F.when(F.col("event_type") == "signup", F.lit("high")).otherwise(F.floor("value").cast("string")),
        F.lit("%\nReason: "),
        F.col("props"),
    )
    failed = F.when(F.col("event_type") == "error", F.lit("timeout"))
    read = e.select("event_id", parsing.verdict(reply, failed).alias("_v"))
    return read.select("event_id", "_v.similar", "_v.confidence", "_v.reason")


# Themes


def theme_registry(spark, d):
    return themes.register(fx.occurrences(spark, d)).select("theme", "n", _r6("confidence", "confidence"))


def theme_registry_padded(spark, d):
    """Names with blanks around them and each text's themes once more in capitals, before and after."""
    occ = fx.occurrences(spark, d)
    twice = F.explode(F.array(*[F.struct((F.col("pos") * 3 + F.lit(k)).alias("pos"), t.alias("theme")) for k, t in enumerate(
        (F.concat(F.lit("  "), F.col("theme"), F.lit("\t")), F.upper("theme"), F.col("theme")))])).alias("t")
    padded = occ.select("row_id", "confidence", twice).select("row_id", "t.pos", "t.theme", "confidence")
    return themes.register(padded).select("theme", "n", "first_row", F.col("first_pos").cast("bigint").alias("first_pos"))


def registry_of_runs(spark, d):
    """The documents in three runs by id, whose registries are merged in another order."""
    occ = stage(fx.occurrences(spark, d))
    share = F.floor(F.col("row_id") * 3 / (occ.agg(F.max("row_id")).head()[0] + 1))
    runs = [themes.run_registry(occ.filter(share == k), k) for k in (2, 0, 1)]
    merged = themes.merge_registries(runs[0], themes.merge_registries(*runs[1:]))
    return merged.select("theme", "n", _r6(F.col("confidence_sum") / F.col("n"), "confidence"), "first_row", F.col("first_pos").cast("bigint").alias("first_pos"))


def theme_frequency(spark, d):
    return fx.stats(spark, d).select("theme", "n")


def theme_confidence(spark, d):
    return fx.stats(spark, d).select("theme", "n", _r6("confidence", "confidence"))


def case_map_running(spark, d):
    return themes.case_map(fx.stats(spark, d), "running")


def case_map_global(spark, d):
    return themes.case_map(fx.stats(spark, d), "global")


def entry_themes(spark, d):
    return fx.merged_entries(spark, d).select(
        "row_id",
        _bar("themes").alias("themes"),
        F.size("merged").cast("bigint").alias("n_merged"),
        _r6(themes.average_confidence("merged"), "average_confidence"),
    )


def themes_merged(spark, d):
    return themes.themes_merged(fx.stats(spark, d))


def entry_theme_limits(spark, d):
    kept = fx.entries(spark, d).select("row_id", themes.limit_themes("original", 3).alias("_kept"))
    total = F.aggregate(F.transform("_kept", lambda e: e["confidence"]), F.lit(0.0), lambda a, x: a + x)
    return kept.select("row_id", _bar(names("_kept")).alias("themes"), _r6(total, "confidence_sum"))


def high_confidence_themes(spark, d):
    return fx.merged_entries(spark, d).select("row_id", _bar(themes.high_confidence("merged", "themes")).alias("themes"))


def entry_confidence(spark, d):
    return fx.entries(spark, d).select("row_id", _r6(themes.average_confidence("original"), "average_confidence"))


def distinct_themes(spark, d):
    return _numbered(spark, d)


def needs_consolidation(spark, d):
    """The skip rule for several theme counts."""
    found = stage(_numbered(spark, d))
    rows = [(n, themes.needs_consolidation(found, n)) for n in (10, 1000, 1_000_000)]
    return spark.createDataFrame(rows, "final_count bigint, consolidate boolean")


def consolidation_rounds(spark, d):
    """The final themes of several rounds, 500 themes a request; the model names first letters."""

    def ask(prompt: str) -> str:
        if "THEMES:" not in prompt or "REPLY FORMAT, " not in prompt:
            return ""
        listed = {line[2].upper() for line in prompt.split("\n") if line.startswith("- ")}
        return "\n".join(f"{i + 1}. {letter}" for i, letter in enumerate(sorted(listed)))

    options = Options(themes_per_consolidation=500)
    found, _ = analysis.consolidate(stage(_distinct(spark, d)), ask, options, F.current_timestamp())
    return spark.createDataFrame(list(enumerate(found)), "position bigint, theme string")


def consolidated_themes(spark, d):
    merged = fx.merged_entries(spark, d)
    out = themes.consolidated(merged, fx.group_map(merged))
    return out.select("row_id", _bar("consolidated").alias("consolidated"))


def fallback_themes(spark, d):
    return themes.sorted_themes(fx.stats(spark, d), 10).select("theme", "n")


def containment_pairs(spark, d):
    return similar.containment_pairs(_distinct(spark, d))


def merge_suggestions(spark, d):
    return similar.merge_suggestions(_registered(spark, d))


def _merges(stats):
    """Merge every theme into its capitalised form, whether that exists or not."""
    target = F.concat(F.upper(F.substring("theme", 1, 1)), F.lower(F.substr("theme", F.lit(2))))
    return stats.select(F.col("theme").alias("from_theme"), target.alias("to_theme"))


def merged_themes(spark, d):
    stats = freeze(fx.stats(spark, d))
    return themes.merge_themes(stats, _merges(stats)).select("theme", "n", _r6("confidence", "confidence"))


def merge_outcome(spark, d):
    stats = freeze(fx.stats(spark, d))
    return themes.merge_outcome(stats, _merges(stats))


def top_themes(spark, d):
    return themes.sorted_themes(themes.register(fx.occurrences(spark, d)), 25).select("theme", "n")


def theme_totals(spark, d):
    return themes.theme_totals(fx.stats(spark, d))


def theme_lookup(spark, d):
    stats = freeze(fx.stats(spark, d))
    asked = stats.select(F.explode(F.array("theme", F.upper("theme"))).alias("theme")).distinct()
    return themes.theme_lookup(stats, asked).select("theme", "n", _r6("confidence", "confidence"))


def theme_examples(spark, d):
    return _examples(spark, d).select("theme", "rank", "row_id", "total", F.md5("text").alias("text_md5"))


def known_themes(spark, d):
    return themes.known_themes(themes.register(fx.occurrences(spark, d))).select("theme", "n")


# Reports


def result_rows(spark, d):
    results, _ = fx.run(spark, d)
    source = cleaning.clean_texts(fx.documents(spark, d)).select("row_id", "text", "lang", "source")
    return (
        reports.result_table(source, results)
        .withColumn("text_md5", F.md5("text"))
        .withColumn("average_confidence", F.round("average_confidence", 6))
        .drop("text")
    )


def batch_stats(spark, d):
    df = reports.batch_stats(*fx.run(spark, d))
    return df.withColumns({c: F.round(c, 6) for c in ("duration_seconds", "average_confidence", "success_rate")})


def session_stats(spark, d):
    df = reports.session_stats(*fx.run(spark, d))
    doubles = ("session_duration", "average_batch_size", "tokens_per_entry", "average_themes_per_entry", "overall_confidence")
    return df.withColumns({c: F.round(c, 6) for c in doubles})


def processing_stats(spark, d):
    df = reports.processing_stats(fx.run(spark, d)[1])
    return df.withColumns({c: F.round(c, 6) for c in ("success_rate", "total_processing_time", "average_time_per_batch")})


def summary_metrics(spark, d):
    return reports.summary_metrics(*fx.run(spark, d)).withColumn("position", F.col("position").cast("bigint"))


def theme_count_tables(spark, d):
    return reports.theme_count_tables(fx.run(spark, d)[0]).select("stage", "theme", "n")


def charted_themes(spark, d):
    return reports.top_theme_counts(reports.theme_count_tables(fx.run(spark, d)[0])).select("stage", "theme", "n")


def theme_report(spark, d):
    return reports.theme_report(*fx.run(spark, d))[0]


def report_statistics(spark, d):
    df = reports.theme_report(*fx.run(spark, d))[1]
    doubles = ("processing_time_seconds", "average_themes_per_entry", "overall_confidence")
    return df.withColumns({c: F.round(c, 6) for c in doubles})


def _registry_and_merged(results):
    seen = themes.occurrences(results)
    return themes.register(themes.occurrences(results, "merged")), themes.themes_merged(themes.theme_stats(seen))


def analysis_summary(spark, d):
    """All fields of the summary."""
    results, batches = fx.run(spark, d)
    df = reports.analysis_summary(results, batches, *_registry_and_merged(results))
    top = F.transform("top_themes", lambda t: F.concat(t["name"], F.lit(" "), t["frequency"].cast("string")))
    parts = [(p, f) for p in ("session_stats", "theme_stats", "processing_stats") for f in df.schema[p].dataType.fields]
    value = lambda p, f: F.round(f"{p}.{f.name}", 6) if f.dataType.simpleString() == "double" else F.col(f"{p}.{f.name}")
    return df.select(*[value(p, f).alias(f"{p}_{f.name}") for p, f in parts], _bar(top).alias("top_themes"))


def statistics_json(spark, d):
    """The statistics document; doubles of the summary line are read back and rounded."""
    results, batches = fx.run(spark, d)
    stats = themes.theme_stats(themes.theme_occurrences(results, "consolidated"))
    written = reports.statistics_json(results, batches, stats)
    fields = ("total_entries", "unique_themes", "processing_time_seconds", "average_themes_per_entry", "overall_confidence")
    read = F.from_json("json", ", ".join(f"{f} double" for f in fields))
    numbers = F.concat_ws(" ", *[F.concat(F.lit(f), F.lit("="), F.format_number(read[f], 4)) for f in fields])
    return written.select("section", F.when(F.col("section") == "analysis_summary", F.replace(numbers, F.lit(","), F.lit(""))).otherwise(F.col("json")).alias("json"))


def result_json(spark, d):
    results, _ = fx.run(spark, d)
    plain = results.withColumn("merged", F.slice("merged", 1, 0)).withColumn("original", F.slice("original", 1, 0))
    return reports.result_json(plain, fx.documents(spark, d)).select("row_id", F.md5("json").alias("json_md5"))


def result_json_confidences(spark, d):
    """Both confidence maps of the result documents, read back from JSON."""
    results, _ = fx.run(spark, d)
    documents = reports.result_json(results, fx.documents(spark, d))
    doc = F.from_json("json", "theme_confidences map<string,double>, original_theme_confidences map<string,double>")
    read = documents.select("row_id", doc.alias("d"))
    parts = [
        read.select("row_id", F.lit(kind).alias("kind"), F.explode(f"d.{kind}").alias("theme", "confidence"))
        for kind in ("theme_confidences", "original_theme_confidences")
    ]
    return parts[0].unionByName(parts[1]).select("row_id", "kind", "theme", _r6("confidence", "confidence"))


RESULT_FIELDS = (
    "original_text string, summary string, themes array<string>, theme_confidences map<string,double>, original_themes array<string>, "
    "original_theme_confidences map<string,double>, consolidated_themes array<string>"
)


def _whole_results(results: Column) -> Column:
    """All fields of an array of result documents, each document as a digest."""
    sure = lambda m: _bar(F.transform(F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,double>")))), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 100).cast("int").cast("string"))))
    whole = lambda r: F.md5(F.concat_ws("~", r["original_text"], r["summary"], _bar(r["themes"]), sure(r["theme_confidences"]), _bar(r["original_themes"]), sure(r["original_theme_confidences"]), _bar(r["consolidated_themes"])).cast("binary"))
    return F.array_join(F.transform(results, whole), ",")


def _whole_batches(documents: DataFrame) -> DataFrame:
    """All ten fields of batch documents (a VARIANT), read by path."""
    field = lambda path, kind: F.variant_get("document", f"$.{path}", kind)
    counts = F.array_sort(F.map_entries(field("themes_summary", "map<string,bigint>")))
    return documents.select(
        "batch_id",
        _whole_results(field("results", f"array<struct<{RESULT_FIELDS.replace(' ', ': ').replace(',: ', ', ')}>>")).alias("results"),
        F.unix_micros(field("processing_start", "timestamp")).alias("start_us"),
        F.unix_micros(field("processing_end", "timestamp")).alias("end_us"),
        _r6(field("processing_duration", "double"), "processing_duration"),
        field("tokens_used", "bigint").alias("tokens_used"),
        field("api_calls", "bigint").alias("api_calls"),
        _bar(field("errors", "array<string>")).alias("errors"),
        _bar(F.transform(counts, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))).alias("themes_summary"),
        _r6(field("average_confidence", "double"), "average_confidence"),
        _r6(field("success_rate", "double"), "success_rate"),
    )


def batch_json(spark, d):
    results, batches = fx.run(spark, d)
    written = reports.batch_json(reports.result_documents(results, fx.documents(spark, d)), results, batches)
    return _whole_batches(written.select("batch_id", F.parse_json("json").alias("document")))


def batch_variants(spark, d):
    """Batch documents kept as VARIANT in a table."""
    results, batches = fx.run(spark, d)
    return _whole_batches(stage(reports.batch_variants(reports.result_documents(results, fx.documents(spark, d)), results, batches)))


def result_variants(spark, d):
    """All fields of result documents kept as VARIANT in a table."""
    results, _ = fx.run(spark, d)
    kept = stage(reports.result_variants(results, fx.documents(spark, d)))
    whole = F.variant_get("document", "$", f"struct<{RESULT_FIELDS.replace(' ', ': ').replace(',: ', ', ')}>")
    return kept.select("row_id", _whole_results(F.array(whole)).alias("document"))


# Advertised features


def theme_cooccurrence(spark, d):
    df = similar.cooccurrence(fx.merged_entries(spark, d))
    return df.withColumn("jaccard", F.round("jaccard", 6))


def hierarchy_rollup(spark, d):
    """Two parents per theme: its first letter and its length."""
    occ = freeze(fx.occurrences(spark, d))
    used = occ.select("theme").distinct()
    parents = F.explode(F.array(F.upper(F.substring("theme", 1, 1)), F.concat(F.lit("length "), F.length("theme").cast("string"))))
    edges = used.select(parents.alias("parent"), F.col("theme").alias("child"))
    return similar.hierarchy_rollup(occ, edges)


def _deep_edges(occ):
    """Three levels over each theme by its first letters; besides, lengths that are each other's parents in twos."""
    t = F.col("theme")
    first, second, size = F.concat(F.lit("* "), F.upper(F.substring(t, 1, 1))), F.concat(F.lit("* "), F.upper(F.substring(t, 1, 2))), F.length(t)
    length = lambda n: F.concat(F.lit("length "), n.cast("string"))
    pair = F.when(size % 2 == 0, size + 1).otherwise(size - 1)
    edges = [(second, t), (first, second), (F.lit("*"), first), (length(size), t), (length(size), length(pair)), (length(pair), length(size))]
    made = F.explode(F.array(*[F.struct(p.alias("parent"), c.alias("child")) for p, c in edges])).alias("e")
    return occ.select("theme").distinct().select(made).select("e.*")


def hierarchy_closure(spark, d):
    return hierarchy.closure(_deep_edges(fx.occurrences(spark, d)))


def hierarchy_counts(spark, d):
    occ = stage(fx.occurrences(spark, d).select("row_id", "theme"))
    return hierarchy.hierarchy_counts(occ, _deep_edges(occ))


def theme_quality(spark, d):
    df = similar.theme_quality(freeze(fx.stats(spark, d)))
    return df.withColumn("confidence", F.round("confidence", 6))


def similar_vectors(spark, d):
    """Groups of alike vectors; a document's length stands in for a theme's count."""
    vectors = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    counts = fx.documents(spark, d).select(F.col("row_id").alias("id"), F.col("n_chars").alias("n"))
    stats = vectors.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return semantic.similar_themes(stats, 0.4)


def similar_vectors_in_cells(spark, d):
    """Many cells, as a map of names (here the sources and ids of vectors)."""
    vectors = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 7).alias("n"))
    targets = semantic.similar_themes(vectors.select("id", "n", "embedding"), 0.4, vectors_per_pivot=40)
    return semantic.theme_map(targets, vectors.select("id", F.concat_ws(" ", "label", "id").alias("theme")))


def banded_recall(spark, d):
    """How many alike pairs the banded search finds, counted against all pairs of every tenth vector."""
    vectors = stage(fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    rows = [hyperplanes.recall_of(vectors, t, vectors.filter("id % 10 = 0")) for t in (0.3, 0.35, 0.4)]
    return reduce(DataFrame.unionByName, rows).select("threshold", "pairs", (F.col("recall") >= 0.9).alias("enough"))


def banded_vectors(spark, d):
    """The banded search, set to miss one in a million, gives the groups of the exact one."""
    vectors = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.lit(1).alias("n"))
    return semantic.similar_themes(vectors, 0.4, links=lambda v, t: hyperplanes.banded_links(v, t, recall=0.999999))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        checked_tables, missing_cells, decoded_texts, csv_files, tsv_files, flat_results,
        load_report, clean_texts, streamed_first_copies, clean_conversations,
        token_counts, token_distribution, sketched_bounds, batch_size_recommendation, cost_forecast, prompt_token_estimate, usage_cost,
        fixed_batches, packed_batches,
        batch_requests, hinted_batch_requests, theme_writeup_requests, quote_requests, pair_requests, mapping_requests,
        consolidation_request, consolidation_rounds,
        cache_lookup, bucketed_cache, cache_upsert, cache_stats, cache_expire, usage_stats, embedding_lookup, model_batch_inference,
        journaled_inference, calls_by_kind, batch_usage,
        parsed_entries, parsed_themes, parsed_consolidation, parsed_mapping, parsed_quotes, parsed_verdicts,
        theme_registry, theme_registry_padded, registry_of_runs, theme_frequency, theme_confidence, case_map_running, case_map_global, entry_themes,
        themes_merged, entry_theme_limits, high_confidence_themes, entry_confidence, distinct_themes,
        needs_consolidation, consolidated_themes, fallback_themes, containment_pairs, merge_suggestions, merged_themes,
        merge_outcome, top_themes, theme_totals, theme_lookup, theme_examples, known_themes,
        result_rows, batch_stats, session_stats, processing_stats, summary_metrics, theme_count_tables, charted_themes,
        theme_report, report_statistics, analysis_summary, statistics_json, result_json, result_json_confidences,
        batch_json, batch_variants, result_variants,
        theme_cooccurrence, similar_vectors, similar_vectors_in_cells, banded_recall, banded_vectors, hierarchy_rollup, hierarchy_closure, hierarchy_counts, theme_quality,
    )
}
