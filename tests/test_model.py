import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from themeloom.operators import model, requests

NOW = "timestamp '2024-01-31 12:00:00'"
CACHE = "prompt_md5 string, response string, cached_at timestamp"


def asked(spark, *prompts):
    return requests.with_key(spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "batch_id bigint, prompt string"))


def cached(spark, *rows):
    keyed = spark.createDataFrame([(p, r, dt.datetime.fromisoformat(t)) for p, r, t in rows], "prompt string, response string, cached_at timestamp")
    return requests.with_key(keyed).select("prompt_md5", "response", "cached_at")


def test_key_is_the_md5_of_the_prompt(spark):
    import hashlib

    assert asked(spark, "é x").first()["prompt_md5"] == hashlib.md5("é x".encode()).hexdigest()


def test_lookup_ages_and_empty_responses(spark):
    cache = cached(
        spark,
        ("a", "old enough", "2024-01-24 12:00:00"),
        ("b", "too old", "2024-01-24 11:59:59"),
        ("c", "", "2024-01-31 00:00:00"),
        ("d", "fresh", "2024-01-31 00:00:00"),
    )
    found = model.cache_lookup(asked(spark, "a", "b", "c", "d", "e"), cache, F.expr(NOW))
    assert {r["prompt"]: (r["hit"], r["response"]) for r in found.collect()} == {
        "a": (True, "old enough"),
        "b": (False, None),
        "c": (False, None),
        "d": (True, "fresh"),
        "e": (False, None),
    }
    row = model.cache_stats(found).first()
    assert (row["hits"], row["misses"], row["hit_rate"]) == (2, 3, 0.4)
    assert model.cache_stats(found.limit(0)).first()["hit_rate"] == 0.0
    kept, counts = model.cache_expire(cache, F.expr(NOW))
    assert (kept.count(), counts.first()["removed"]) == (3, 1)
    emptied, removed = model.cache_clear(cache)
    assert (emptied.count(), removed.first()["removed"]) == (0, 4)


def test_last_write_wins(spark):
    old = cached(spark, ("a", "1", "2024-01-01 00:00:00"), ("b", "late", "2024-01-09 00:00:00"), ("c", "tie old", "2024-01-05 00:00:00"))
    new = cached(spark, ("a", "2", "2024-01-02 00:00:00"), ("b", "early", "2024-01-03 00:00:00"), ("c", "tie new", "2024-01-05 00:00:00"))
    assert sorted(r["response"] for r in model.cache_upsert(old, new).collect()) == ["2", "late", "tie new"]


def test_many_writes_of_a_key(spark):
    rows = [("hot", f"r{i}", f"2024-01-01 00:00:{i % 50:02}.000{i:03}") for i in range(500)] + [("tie", f"t{i}", "2024-01-01 00:00:00") for i in range(9)]
    old = cached(spark, ("cold", "stays", "2023-12-01 00:00:00"), ("tie", "older", "2023-12-01 00:00:00"))
    new = cached(spark, *rows).coalesce(1)
    kept = {r["response"] for r in model.cache_upsert(old, new).collect()}
    assert kept == {"r499", "t8", "stays"}
    naive = new.withColumn("cached_at", F.col("cached_at").cast("timestamp_ntz"))
    assert {r["response"] for r in model.latest_writes(naive).collect()} == {"r499", "t8"}
    assert model.cache_upsert(old.limit(0), new.limit(0)).count() == 0


def _exchanges(df):
    return [line.strip(" +-:") for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_a_cache_in_buckets_is_not_shuffled(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    model.store_cache(cached(spark, *[(f"p{i}", f"r{i}", "2024-01-31 00:00:00") for i in range(50)]), path, 6)
    monkeypatch.setattr(model, "broadcast_if_small", lambda t, **_: t.hint("merge"))
    found = model.cache_lookup(asked(spark, "p1", "p2", "other"), model.open_cache(spark, path), F.expr(NOW))
    assert [e for e in _exchanges(found) if "hashpartitioning(prompt_md5" not in e] == [] and len(_exchanges(found)) == 1
    assert {r["prompt"]: r["response"] for r in found.collect()} == {"p1": "r1", "p2": "r2", "other": None}
    after = model.cache_upsert(model.open_cache(spark, path), cached(spark, ("p1", "late", "2024-02-01 00:00:00")))
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    # Of the join by key only the side of the new replies moves.
    assert sum("hashpartitioning(prompt_md5" in e for e in _exchanges(after)) == 1
    assert after.count() == 50 and after.filter("response = 'late'").count() == 1
    # Another application knows the files only.
    spark.sql(f"drop table {model._cache_name(path)}")
    again = model.open_cache(spark, path)
    assert again.count() == 50 and len(_exchanges(model.cache_lookup(asked(spark, "p1"), again, F.expr(NOW)))) == 1


def test_a_failing_call_is_a_row(spark):
    def ask(prompt):
        if prompt == "bad":
            raise RuntimeError("no luck")
        return prompt.upper()

    replies = model.run_model(asked(spark, "x", "bad", "x", "y"), ask, tasks=3)
    rows = {(r["response"], r["error"]) for r in replies.collect()}
    assert rows == {("X", None), (None, "no luck"), ("Y", None)}
    assert replies.count() == 3


def test_requests_with_a_response_are_not_asked(spark):
    df = spark.createDataFrame([(0, "a", "known"), (1, "éb", None), (2, "c", None)], "batch_id bigint, prompt string, response string")
    replies = model.ask_model(requests.with_key(df), lambda p: p * 2 if p != "c" else 1 / 0, ["batch_id"])
    rows = {r["batch_id"]: (r["prompt_length"], r["response"], r["error"]) for r in replies.collect()}
    assert rows == {0: (1, "known", None), 1: (2, "ébéb", None), 2: (1, None, "division by zero")}


def test_embeddings_fall_back_to_single_texts(spark):
    def embed(texts):
        if "bad" in texts:
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, "ccc")], "row_id bigint, text string").coalesce(1)
    rows = {r["row_id"]: r["embedding"] for r in model.embed_texts(df, embed, "row_id").collect()}
    assert rows == {0: [1.0, 1.0], 1: None, 2: [3.0, 1.0]}


def test_usage(spark):
    log = spark.createDataFrame([(10, 5, True), (20, 5, True), (99, 0, False)], "prompt_tokens bigint, response_tokens bigint, ok boolean")
    row = model.usage_stats(log).first()
    assert (row["total_requests"], row["total_tokens"], row["failed_requests"]) == (3, 40, 1)
    assert round(row["success_rate"], 4) == 0.6667
    empty = model.usage_stats(log.limit(0)).first()
    assert (empty["success_rate"], empty["tokens_per_request"], empty["total_tokens"]) == (0.0, 0.0, 0)


def test_batch_usage_counts_cached_calls_by_choice(spark):
    df = spark.createDataFrame(
        [(0, 2, 4, "efgh", None, True), (1, 1, 4, None, "boom", False)],
        "batch_id bigint, n_texts bigint, prompt_length bigint, response string, error string, hit boolean",
    )
    rows = {r["batch_id"]: (r["tokens_used"], r["api_calls"], r["errors"]) for r in model.batch_usage(df).collect()}
    assert rows == {0: (2, 1, []), 1: (0, 0, ["boom"])}
    assert model.batch_usage(df, count_cached_calls=False).filter("batch_id = 0").first()["api_calls"] == 0


def test_requests_number_texts_in_order(spark):
    df = spark.createDataFrame([(0, 1, 7, "second"), (0, 0, 5, "first"), (1, 0, 9, "alone")], "batch_id bigint, pos int, row_id bigint, text string")
    rows = requests.batch_requests(df, question="Why?", known_themes=["K1", "K2"]).orderBy("batch_id").collect()
    assert rows[0]["members"] == [5, 7]
    assert "1: first\n2: second" in rows[0]["prompt"]
    assert "K1, K2" in rows[0]["prompt"] and '"Why?"' in rows[0]["prompt"]
    literal = requests.batch_requests(df, separator="\\n").filter("batch_id = 0").first()["prompt"]
    assert "1: first\\n2: second" in literal


def test_writeup_request_mentions_what_is_not_shown(spark):
    df = spark.createDataFrame([("t", 1, "one", 5), ("t", 2, "two", 5), ("u", 1, "x", 1)], "theme string, rank bigint, text string, total bigint")
    rows = {r["theme"]: r["prompt"] for r in requests.theme_writeup_requests(df).collect()}
    assert 'EXAMPLES (2 of 5):\n- "one"\n- "two"\n(and 3 others)' in rows["t"]
    assert "others" not in rows["u"]


def test_consolidation_splits_long_theme_lists(spark):
    df = spark.createDataFrame([(f"t{i}", i) for i in range(7)], "theme string, seq bigint")
    rows = requests.consolidation_requests(df, 3, themes_per_request=4).orderBy("chunk_id").collect()
    assert [r["n_themes"] for r in rows] == [4, 3]
    assert "- t4\n- t5\n- t6" in rows[1]["prompt"]
