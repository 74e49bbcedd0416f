"""Inputs of the registered queries, derived by Spark from the given tables.

No model runs here, so a text's themes are stood in for by a rule over the whole text: of its
distinct words of six or more ASCII letters the five shortest, ties by byte order. Case is kept,
which gives spelling variants. Confidence follows from length and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.storage import freeze
from themeloom.operators import batching, cleaning, model, parsing, requests, themes
from themeloom.sources.tables import read_table

QUESTION = "What would you change?"
AS_OF = "timestamp_ntz '2024-01-31 00:00:00'"
# A text under this length gets no line in the reply, so later entries move up and the end is padded.
UNANSWERED_BELOW = 60
# A batch with a text over this length fails, as it would pass a model's limit.
FAILS_ABOVE = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "row_id")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with missing, blank and padded answers, by source."""
    noisy = (
        F.when(F.col("source") == "src3", F.lit(None))
        .when(F.col("source") == "src4", F.lit("   "))
        .when(F.col("source") == "src5", F.concat(F.lit("  "), "text", F.lit("\t")))
        .otherwise(F.col("text"))
    )
    return documents(spark, sf_dir).select("row_id", noisy.alias("text"), "lang", "source")


def named_themes(text: str = "text") -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]{6,}"), F.lit(0)))
    by_length = F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    return F.transform(F.slice(by_length, 1, 5), lambda s: s["w"])


def percent(theme: Column, pos: Column) -> Column:
    return 50 + (F.length(theme) * 7 + pos * 13) % 51


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide entries ``row_id, original`` of all documents."""
    named = documents(spark, sf_dir).select("row_id", named_themes().alias("_names"))
    pairs = F.transform(
        "_names", lambda t, i: F.struct(t.alias("theme"), (percent(t, i) / 100.0).alias("confidence"))
    )
    return named.select("row_id", pairs.alias("original"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.occurrences(entries(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.theme_stats(occurrences(spark, sf_dir))


def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the case map applied. Frozen, as are the entries before, so that texts are
    read once however often these are used."""
    wide = freeze(entries(spark, sf_dir))
    return freeze(themes.entry_themes(wide, themes.case_map(themes.theme_stats(themes.occurrences(wide)))))


def group_map(merged: DataFrame) -> DataFrame:
    """Themes used more than once map to their first letter; the others are unmapped."""
    used = themes.theme_stats(themes.theme_occurrences(merged))
    return used.filter("n > 1").select("theme", F.upper(F.substring("theme", 1, 1)).alias("target"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.fixed_batches(cleaning.clean_texts(documents(spark, sf_dir)))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch requests with replies in the batch format."""
    source = documents(spark, sf_dir)
    keys = cleaning.clean_keys(source)
    asked = requests.batch_requests(
        batching.fixed_batches(cleaning.clean_texts(source, keys=keys)), question=QUESTION
    )
    told = source.select("row_id", F.length("text").alias("_n"), named_themes().alias("_names"))
    placed = batching.fixed_batches(told.join(keys, "row_id"))
    marks = F.transform("_names", lambda t, i: F.concat(t, F.lit(" ("), percent(t, i).cast("string"), F.lit("%)")))
    line = F.concat(
        (F.col("pos") + 1).cast("string"),
        F.lit(": doc "),
        F.col("row_id").cast("string"),
        F.lit("|"),
        F.array_join(marks, ","),
    )
    replies = (
        placed.select("batch_id", "pos", "_n", F.when(F.col("_n") >= UNANSWERED_BELOW, line).alias("_line"))
        .groupBy("batch_id")
        .agg(
            F.max("_n").alias("_longest"),
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("pos", "_line")))),
                lambda x: x["_line"],
            ).alias("_lines"),
        )
    )
    failed = F.col("_longest") > FAILS_ABOVE
    # As after the model, the length of the prompt goes on in place of the prompt.
    sent = asked.select("batch_id", "n_texts", "members", "prompt_md5", F.length("prompt").cast("bigint").alias("prompt_length"))
    return sent.join(replies, "batch_id").select(
        *sent.columns,
        F.when(~failed, F.array_join("_lines", "\n")).alias("response"),
        F.when(failed, F.lit("text too long")).alias("error"),
        F.lit(False).alias("hit"),
    )


def run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``results`` and ``batches`` of a whole run with the replies above."""
    replies = freeze(answered(spark, sf_dir))
    parsed = freeze(parsing.batch_entries(replies))
    spelling = themes.case_map(themes.theme_stats(themes.occurrences(parsed)))
    merged = freeze(themes.entry_themes(parsed, spelling))
    results = freeze(themes.consolidated(merged, group_map(merged)))
    start = F.timestamp_seconds(F.lit(1704067200) + F.col("batch_id") * 60)
    used_batches = model.batch_usage(replies).withColumn("start_ts", start)
    end = F.timestamp_micros(F.unix_micros("start_ts") + F.col("tokens_used") * 1000)
    return results, freeze(used_batches.withColumn("end_ts", end))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.floor(F.col("value") * 10).cast("bigint").alias("prompt_tokens"),
        F.floor("value").cast("bigint").alias("response_tokens"),
        (F.col("event_type") != "error").alias("ok"),
    )


def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history of cache writes: one key per user, an empty response for an error."""
    return table(spark, sf_dir, "events").select(
        F.md5(F.col("user_id").cast("string").cast("binary")).alias("prompt_md5"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat("event_type", F.lit(" "), "event_id")).alias("response"),
        F.col("ts").alias("cached_at"),
        "event_type",
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after the clicks and purchases were written over the rest."""
    writes = cache_writes(spark, sf_dir)
    new = F.col("event_type").isin("click", "purchase")
    return freeze(model.cache_upsert(model.latest_writes(writes.filter(~new)), writes.filter(new)))


def cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), keys.alias("prompt"), F.md5(keys.cast("binary")).alias("prompt_md5")
    )


def as_of() -> Column:
    return F.expr(AS_OF)
