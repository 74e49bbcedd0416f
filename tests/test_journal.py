"""Replies that outlive the task that asked, and calls by kind of request."""

import os
import subprocess
import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from themeloom import Options
from themeloom.operators import model, requests
from themeloom.operators.journal import Journal, Reply
from themeloom.options import CALLS, Call
from themeloom.plans import analysis

REPO = Path(__file__).resolve().parents[1]


def asked(spark, n, partitions=2):
    df = spark.range(n, numPartitions=partitions).select("id", F.concat(F.lit("prompt "), "id").alias("prompt"))
    return requests.with_key(df, kind="mapping")


def test_a_reply_is_kept_whole_and_once(tmp_path):
    journal = Journal(f"file:{tmp_path}/kept/")
    now = datetime(2024, 1, 31, tzinfo=timezone.utc)
    assert journal.read("ab12") is None
    journal.write("ab12", Reply("é\n\"x\"", now, now))
    journal.write("ab12", Reply("later", now, now))
    assert Journal(str(tmp_path / "kept")).read("ab12") == Reply("later", now, now)
    assert [p.name for p in (tmp_path / "kept" / "ab").iterdir()] == ["ab12"]


def test_a_task_that_dies_half_way_asks_for_the_rest_only(tmp_path):
    """A worker dies after half of its calls; the task's next attempt asks for what is not in the journal."""
    code = f"""
import os, sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession, functions as F
from themeloom.operators import model, requests
spark = SparkSession.builder.master('local[2,3]').config('spark.ui.enabled', 'false').getOrCreate()
log = {str(tmp_path / "calls")!r}
def ask(prompt):
    with open(log, 'a') as f:
        f.write(prompt + '\\n')
    if prompt == 'prompt 15' and open(log).read().split('\\n').count('prompt 15') == 1:
        os._exit(1)
    return prompt.upper()
df = requests.with_key(spark.range(30, numPartitions=1).select('id', F.concat(F.lit('prompt '), 'id').alias('prompt')))
replies = model.ask_model(df, ask, ['id'], journal={str(tmp_path / "journal")!r})
print(sorted((r['id'], r['response'], r['error']) for r in replies.collect()) == [(i, f'PROMPT {{i}}', None) for i in range(30)])
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip().endswith("True"), out.stderr[-2000:]
    calls = (tmp_path / "calls").read_text().split("\n")[:-1]
    # The call during which the worker died had no reply to keep.
    assert sorted(calls) == sorted([f"prompt {i}" for i in range(30)] + ["prompt 15"])


def test_a_later_run_reads_the_journal(spark, tmp_path):
    log, folder = str(tmp_path / "calls"), str(tmp_path / "journal")

    def ask(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        if prompt.endswith("3"):
            raise RuntimeError("not now")
        return prompt.upper()

    def again(prompt):
        with open(log, "a") as f:
            f.write("again " + prompt + "\n")
        return "late"

    first = {r["id"]: tuple(r) for r in model.ask_model(asked(spark, 20), ask, ["id"], journal=folder).collect()}
    second = {r["id"]: tuple(r) for r in model.ask_model(asked(spark, 20, 5), again, ["id"], journal=folder).collect()}
    # Errors are not kept; replies keep their times.
    assert sorted(i for i in first if first[i] != second[i]) == [3, 13]
    calls = open(log).read().split("\n")[:-1]
    assert sorted(calls) == sorted([f"prompt {i}" for i in range(20)] + ["again prompt 3", "again prompt 13"])


def test_the_callable_sees_the_call(spark):
    def ask(prompt, call):
        return f"{call.kind} {call.temperature} {call.max_tokens} {call.deployment}"

    assert {r["response"] for r in model.ask_model(asked(spark, 2), ask).collect()} == {"mapping 0.2 1000 None"}
    calls = {**CALLS, "mapping": Call("mapping", 0.0, 50, "large")}
    assert model.ask_model(asked(spark, 1), ask, calls=calls).first()["response"] == "mapping 0.0 50 large"
    assert model.ask_model(asked(spark, 1).drop("kind"), ask).first()["response"] == "None None None None"
    assert model.ask_model(asked(spark, 1), lambda prompt, retries=3: prompt).first()["response"] == "prompt 0"
    assert model.run_model(asked(spark, 1), ask).first()["response"] == "mapping 0.2 1000 None"


def test_every_request_has_its_kind(spark):
    examples = spark.createDataFrame([("t", 1, "one", 5)], "theme string, rank bigint, text string, total bigint")
    themes = spark.createDataFrame([("t", 0)], "theme string, seq bigint")
    pairs = spark.createDataFrame([("a", "b")], "theme1 string, theme2 string")
    batch = spark.createDataFrame([(0, 0, 7, "text")], "batch_id bigint, pos int, row_id bigint, text string")
    made = [
        requests.batch_requests(batch), requests.theme_writeup_requests(examples), requests.quote_requests(examples), requests.pair_requests(pairs),
        requests.mapping_requests(themes, ["x"]), requests.consolidation_requests(themes),
    ]
    assert [df.first()["kind"] for df in made] == list(CALLS)


@pytest.mark.parametrize("journal", [True, False, "own"])
def test_a_run_keeps_its_replies(spark, tmp_path, journal):
    options = Options(batch_size=1, consolidate=False, journal=str(tmp_path / "own") if journal == "own" else journal)
    source = spark.createDataFrame([(0, "apple pie"), (1, "zebra fish")], "row_id bigint, text string")
    kinds = str(tmp_path / "kinds")

    def ask(prompt, call):
        with open(kinds, "a") as f:
            f.write(f"{call.kind}\n")
        return "1: about it|Thing (90%)"

    run = analysis.analyze(source, ask, options)
    analysis.analyze(source, ask, options)
    assert [r["themes"] for r in run.results.collect()] == [["Thing"]] * 2
    assert open(kinds).read().split("\n")[:-1] == ["batch"] * (2 if journal == "own" else 4)
