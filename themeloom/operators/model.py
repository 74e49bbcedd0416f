"""The model as a boundary between tables: requests out, responses back, and the response cache."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.shipping import ship
from themeloom.functions.storage import broadcast_if_small, stage
from themeloom.operators.journal import Journal, Reply
from themeloom.options import CACHE_DAYS, CALLS, Call

Ask = Callable[[str], str] | Callable[[str, Call], str]

# Rows of a table of writes are numbered below this.
_ROWS = 1 << 62
_REPLY = "prompt_length bigint, response string, error string, started_at timestamp, ended_at timestamp"


def _takes_call(ask: Ask) -> bool:
    """Whether a callable wants the :class:`Call` beside the prompt."""
    try:
        wanted = [p for p in inspect.signature(ask).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty]
    except (TypeError, ValueError):
        return False
    return len(wanted) > 1


def ask_model(
    requests: DataFrame,
    ask: Ask,
    keep: Sequence[str] = (),
    tasks: int | None = None,
    journal: str | None = None,
    calls: Mapping[str, Call] = CALLS,
) -> DataFrame:
    """Send each request's ``prompt`` to ``ask`` on the executors.

    Returns the ``keep`` columns, ``prompt_md5``, the prompt's length in place of the prompt,
    ``response``, ``error`` and the call's start and end. Requests that have a ``response`` already
    are passed on unasked. A call that raises gives an ``error`` and the others go on. A model need
    not answer twice alike, so freeze or write the result before using it more than once.
    ``tasks`` sets how many calls may run side by side.

    ``ask`` takes the prompt, or the prompt and the :class:`Call` that ``calls`` has for the request's
    ``kind`` (one without parameters for a kind that is not there). With a ``journal``, a folder all machines
    share, each reply is kept as it comes, and a prompt whose reply is there is not asked again: a task that
    fails half way asks for the rest only. Errors are not kept. Two attempts at the same task that run at the same
    time may ask twice; the later reply stays.
    """
    kept = ["prompt_md5", *keep]
    given, named, whole = "response" in requests.columns, "kind" in requests.columns, _takes_call(ask)
    extra = [c for c, there in (("response", given), ("kind", named and "kind" not in kept)) if there]
    sent = requests.select(*kept, "prompt", *extra)
    if tasks:
        sent = sent.repartition(tasks, "prompt_md5")
    types = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in kept)
    ship(requests.sparkSession)
    replies = Journal(journal) if journal else None
    by_kind = dict(calls)

    def answer(key: str, prompt: str, kind: str | None) -> tuple:
        found = replies.read(key) if replies else None
        if found:
            return found.response, None, found.started_at, found.ended_at
        started = pd.Timestamp.now(tz="UTC")
        try:
            response = ask(prompt, by_kind.get(kind, Call(kind))) if whole else ask(prompt)
        except Exception as e:  # noqa: BLE001 - whatever the callable raises is that row's result
            return None, str(e) or type(e).__name__, started, pd.Timestamp.now(tz="UTC")
        ended = pd.Timestamp.now(tz="UTC")
        if replies and response is not None:
            replies.write(key, Reply(response, started, ended))
        return response, None, started, ended

    def call(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            empty = [None] * len(frame)
            for key, prompt, known, kind in zip(
                frame["prompt_md5"], frame["prompt"], frame["response"] if given else empty, frame["kind"] if named else empty
            ):
                now = pd.Timestamp.now(tz="UTC")
                rows.append((len(prompt), *((known, None, now, now) if known is not None else answer(key, prompt, kind))))
            columns = ["prompt_length", "response", "error", "started_at", "ended_at"]
            made = pd.DataFrame(rows, columns=columns, index=frame.index)
            yield pd.concat([frame[kept], made], axis=1)

    return sent.mapInPandas(call, f"{types}, {_REPLY}")


def run_model(requests: DataFrame, ask: Ask, tasks: int | None = None, journal: str | None = None) -> DataFrame:
    """Ask each distinct prompt once; join the responses back on ``prompt_md5``."""
    kind = ["kind"] if "kind" in requests.columns else []
    return ask_model(requests.select("prompt_md5", "prompt", *kind).dropDuplicates(["prompt_md5"]), ask, tasks=tasks, journal=journal)


def embed_texts(
    texts: DataFrame, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], key: str, text: str = "text"
) -> DataFrame:
    """``key, embedding`` by a callable that takes many texts at once.

    If a call fails, its texts are tried one by one; those that still fail get null.
    """
    key_type = texts.schema[key].dataType.simpleString()

    def one(text: str):
        try:
            return list(embed([text])[0])
        except Exception:  # noqa: BLE001
            return None

    def call(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            batch = frame[text].tolist()
            try:
                vectors = [list(v) for v in embed(batch)] if batch else []
            except Exception:  # noqa: BLE001
                vectors = [one(t) for t in batch]
            yield pd.DataFrame({key: frame[key], "embedding": vectors})

    return texts.select(key, text).mapInPandas(call, f"{key} {key_type}, embedding array<float>")


def embedding_lookup(themes: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """Attach stored embeddings; null where there is none."""
    return themes.join(embeddings.select(key, "embedding"), key, "left")


def fresh(cached_at: Column | str, as_of: Column, max_age_days: int = CACHE_DAYS) -> Column:
    """Whether a response is still valid: no older than ``max_age_days``, to the second."""
    stamp = F.col(cached_at) if isinstance(cached_at, str) else cached_at
    return stamp >= as_of - F.expr(f"interval {int(max_age_days)} days")


def cache_lookup(requests: DataFrame, cache: DataFrame, as_of: Column, max_age_days: int = CACHE_DAYS) -> DataFrame:
    """Add ``response`` and ``hit``. An expired or empty response is a miss.

    ``cache`` is a stored table with one row per ``prompt_md5`` (see :func:`cache_upsert`). If few
    responses are usable they are broadcast and the prompts stay where they are. Otherwise a cache that
    :func:`open_cache` reads stays where it is and the requests go to its buckets. A prompt
    repeated by many requests widens the request side only.
    """
    usable = cache.filter(fresh("cached_at", as_of, max_age_days) & (F.col("response") != "")).select(
        "prompt_md5", "response"
    )
    known = broadcast_if_small(usable)
    return requests.join(known, "prompt_md5", "left").withColumn("hit", F.col("response").isNotNull())


def latest_writes(writes: DataFrame) -> DataFrame:
    """The last write of each key: the latest, and of those of one time the last row.

    What is reduced are keys and numbers, in a hash aggregate with a map-side half, so a key that is written very often is no hot spot;
    replies move once, for the rows that win.
    """
    stored = stage(writes.select("prompt_md5", "response", "cached_at").withColumn("_row", F.monotonically_increasing_id()))
    if isinstance(writes.schema["cached_at"].dataType, T.TimestampNTZType):
        micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cached_at)")
    else:
        micros = F.unix_micros("cached_at")
    # Time above, row below, as one number.
    order = micros.cast("decimal(19,0)") * F.lit(_ROWS) + F.col("_row")
    last = stored.groupBy("prompt_md5").agg(F.max(order).alias("_last")).select(F.pmod("_last", F.lit(_ROWS)).cast("bigint").alias("_row"))
    return stored.join(broadcast_if_small(stage(last), otherwise="shuffle_hash"), "_row", "left_semi").drop("_row")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after writing ``new``: the latest response per key; at equal times ``new`` wins.

    ``cache`` has a key once, ``new`` may have it often (see :func:`latest_writes`), so one join by the key is all; a cache that
    :func:`open_cache` reads is not shuffled for it. Write the result to a new path, not over the one being read.
    """
    old = cache.select("prompt_md5", F.col("response").alias("_old"), F.col("cached_at").alias("_old_at"))
    late = latest_writes(new).select("prompt_md5", F.col("response").alias("_new"), F.col("cached_at").alias("_new_at"))
    newer = F.col("_old_at").isNull() | F.coalesce(F.col("_new_at") >= F.col("_old_at"), F.lit(False))
    return old.join(late, "prompt_md5", "full").select(
        "prompt_md5", F.when(newer, F.col("_new")).otherwise(F.col("_old")).alias("response"), F.when(newer, F.col("_new_at")).otherwise(F.col("_old_at")).alias("cached_at")
    )


def store_cache(cache: DataFrame, path: str, buckets: int) -> None:
    """Write a cache in ``buckets`` files by key, each sorted, with a note of how many there are."""
    spark = cache.sparkSession
    by_key = cache.select("prompt_md5", "response", "cached_at").repartition(buckets, "prompt_md5")
    by_key.write.bucketBy(buckets, "prompt_md5").sortBy("prompt_md5").option("path", f"{path}/rows").saveAsTable(_cache_name(path))
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(by_key.schema.json()).alias("schema")).coalesce(1).write.json(f"{path}/layout")


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache of :func:`store_cache`, also one of an earlier application: lookups and upserts do not shuffle it."""
    name = _cache_name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema("buckets int, schema string").json(f"{path}/layout").head()
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(layout["schema"])))
        place = f"{path}/rows".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"create table {name} ({columns}) using parquet clustered by (prompt_md5) sorted by (prompt_md5) into {layout['buckets']} buckets location '{place}'"
        )
    return spark.table(name)


def _cache_name(path: str) -> str:
    return f"responses_{hashlib.md5(path.encode()).hexdigest()}"


def cache_stats(looked_up: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a lookup; the rate is 0 when nothing was looked up."""
    return looked_up.agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"),
    )


def cache_expire(cache: DataFrame, as_of: Column, max_age_days: int = CACHE_DAYS) -> tuple[DataFrame, DataFrame]:
    """The entries still valid, and one row with how many were removed and kept."""
    valid = fresh("cached_at", as_of, max_age_days)
    counts = cache.agg(F.count_if(~valid).alias("removed"), F.count_if(valid).alias("kept"))
    return cache.filter(valid), counts


def cache_clear(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The empty cache, and one row with how many entries were removed."""
    return cache.limit(0), cache.agg(F.count(F.lit(1)).alias("removed"))


def usage_stats(log: DataFrame) -> DataFrame:
    """Totals of a request log (``prompt_tokens, response_tokens, ok``).

    Failed requests count as requests, so the success rate stays between 0 and 1.
    """
    n = F.count(F.lit(1))
    tokens = F.coalesce(
        F.sum(F.when(F.col("ok"), F.col("prompt_tokens") + F.col("response_tokens"))), F.lit(0)
    ).cast("bigint")
    return log.agg(
        n.alias("total_requests"),
        tokens.alias("total_tokens"),
        F.count_if(~F.col("ok")).alias("failed_requests"),
        F.when(n > 0, F.count_if("ok") / n).otherwise(F.lit(0.0)).alias("success_rate"),
        F.when(n > 0, tokens / n).otherwise(F.lit(0.0)).alias("tokens_per_request"),
    )


def batch_usage(answered: DataFrame, count_cached_calls: bool = True) -> DataFrame:
    """Per batch: estimated tokens of prompt and reply together, and the number of calls.

    ``answered`` has ``batch_id, n_texts, prompt_length, response, error, hit``. A reply from the
    cache counts as a call unless ``count_cached_calls`` is off. A failed batch has no tokens and
    no call.
    """
    ok = F.col("error").isNull()
    calls = ok if count_cached_calls else ok & ~F.col("hit")
    length = F.col("prompt_length") + F.coalesce(F.length("response"), F.lit(0))
    return answered.select(
        "batch_id",
        "n_texts",
        F.when(ok, F.floor(length / 4)).otherwise(F.lit(0)).cast("bigint").alias("tokens_used"),
        F.when(calls, 1).otherwise(0).cast("bigint").alias("api_calls"),
        F.when(ok, F.array().cast("array<string>")).otherwise(F.array("error")).alias("errors"),
    )
