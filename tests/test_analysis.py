import re

import pytest
from pyspark.sql import functions as F

from themeloom import Options
from themeloom.operators import reports, themes
from themeloom.plans import analysis
from themeloom.sources import sinks
from themeloom.streaming import rowwise


def as_of():
    return F.expr("timestamp '2024-01-31 12:00:00'")


def make_model():
    # Functions of a test module cannot be imported by workers; a nested one is sent along.
    def ask(prompt):
        """Answers each kind of request by its reply format."""
        if "TEXTS:" in prompt:
            if "BOOM" in prompt:
                raise RuntimeError("refused")
            texts = re.findall(r"^(\d+): (\w+) (\w+)", prompt.split("TEXTS:")[1].split("REPLY FORMAT")[0], re.M)
            return "\n".join(f"{n}: about {a}|{a} (90%),{b} (70%)" for n, a, b in texts)
        if "Replace them by" in prompt:
            return "1. Group one\n2. Group two"
        listed = prompt.split("THEMES TO PLACE:\n")[1].split("\n\n")[0].split(", ")
        return "\n".join(f"{t} -> Group {'one' if t[0].lower() < 'n' else 'two'}" for t in listed)

    return ask


fake_model = make_model()


def answers(spark, *texts):
    return spark.createDataFrame([(i, t, f"p{i}") for i, t in enumerate(texts)], "row_id bigint, text string, person string")


TEXTS = ["apple pie", "Apple tart", "zebra fish", "apple pie ", "no", None, "mango BOOM", "mango lassi", "kiwi cake"]


def test_whole_run(spark, tmp_path):
    options = Options(batch_size=2, final_theme_count=2)
    run = analysis.analyze(answers(spark, *TEXTS), fake_model, options, as_of=as_of())
    rows = {r["row_id"]: r for r in run.results.collect()}
    # Rows 3 (copy), 4 (short) and 5 (null) are cleaned away; batches are (0,1), (2,6), (7,8).
    assert sorted(rows) == [0, 1, 2, 6, 7, 8]
    assert rows[0]["themes"] == ["apple", "pie"]
    assert rows[1]["themes"] == ["apple", "tart"]  # no more frequent than the spelling seen first
    assert rows[2]["status"] == rows[6]["status"] == "error"
    assert rows[7]["summary"] == "about mango" and rows[7]["consolidated"] == ["Group one"]
    assert rows[0]["consolidated"] == ["Group one", "Group two"]
    assert run.representatives == ("Group one", "Group two")
    assert {r["theme"]: r["target"] for r in run.case_map.collect()} == {"Apple": "apple"}

    stats = reports.session_stats(run.results, run.batches).first()
    assert (stats["total_batches"], stats["total_entries"], stats["total_api_calls"]) == (3, 4, 2)
    table = analysis.result_table(run)
    assert table.count() == 6 and table.columns[:4] == ["row_id", "text", "person", "summary"]
    assert table.columns[-1] == "processing_timestamp"
    sinks.write_table(table, str(tmp_path / "out"), "csv")
    found = spark.read.csv(str(tmp_path / "out"), header=True)
    assert found.filter("row_id = 0").first()["consolidated_themes"] == "Group one, Group two"


def test_cached_replies_are_not_asked_again(spark):
    options = Options(batch_size=2, consolidate=False)
    source = answers(spark, "apple pie", "zebra fish", "mango lassi")
    first = analysis.analyze(source, fake_model, options, as_of=as_of())
    cache = first.responses.withColumn("cached_at", as_of())
    assert cache.count() == 2

    def refuse(prompt):
        raise RuntimeError("should not be asked")

    second = analysis.analyze(source, refuse, options, cache=cache, as_of=as_of())
    assert [r["status"] for r in second.results.collect()] == ["ok"] * 3
    assert second.responses.count() == 0
    assert [r["consolidated"] for r in second.results.collect()] == [[]] * 3


def test_few_themes_skip_consolidation(spark):
    run = analysis.analyze(answers(spark, "apple pie"), fake_model, as_of=as_of())
    row = run.results.first()
    assert row["consolidated"] == row["themes"] == ["apple", "pie"]
    assert run.theme_map is None


def test_failed_consolidation_takes_the_first_themes(spark):
    def failing(prompt):
        if "TEXTS:" in prompt:
            return fake_model(prompt)
        raise RuntimeError("down")

    run = analysis.analyze(answers(spark, "apple pie", "zebra fish"), failing, Options(final_theme_count=2), as_of=as_of())
    assert run.representatives == ("apple", "pie")
    assert [r["consolidated"] for r in run.results.orderBy("row_id").collect()] == [["apple"], ["apple"]]


def test_long_theme_lists_consolidate_in_rounds(spark):
    texts = [f"word{chr(97 + i)} term{chr(97 + i)}" for i in range(10)]
    seen = []
    options = Options(batch_size=5, final_theme_count=2, themes_per_consolidation=6)
    run = analysis.analyze(answers(spark, *texts), fake_model, options, as_of=as_of())
    assert run.representatives == ("Group one", "Group two")
    assert {t for r in run.results.collect() for t in r["consolidated"]} == {"Group two"}


def test_part_of_a_long_list_may_fail(spark):
    def partly(prompt):
        if "Replace them by" in prompt and "- termf" in prompt and "worda" not in prompt:
            raise RuntimeError("down")
        return fake_model(prompt)

    texts = [f"word{chr(97 + i)} term{chr(97 + i)}" for i in range(10)]
    options = Options(batch_size=5, final_theme_count=2, themes_per_consolidation=6)
    run = analysis.analyze(answers(spark, *texts), partly, options, as_of=as_of())
    assert run.representatives == ("Group one", "Group two")
    with pytest.raises(ValueError):
        Options(final_theme_count=10, themes_per_consolidation=10)


def test_registry_feeds_the_next_run(spark):
    run = analysis.analyze(answers(spark, "apple pie", "Apple tart"), fake_model, Options(batch_size=1), as_of=as_of())
    known = analysis.registry(run)
    prompts = []
    analysis_with_hints = analysis.analyze(
        answers(spark, "kiwi cake"), lambda p: "1: " + ("hinted" if "apple, pie" in p else "plain") + "|X", Options(), as_of=as_of(), known_themes=known
    )
    assert analysis_with_hints.results.first()["summary"] == "hinted"


def test_row_wise_steps_accept_a_stream(spark, tmp_path):
    answers(spark, *TEXTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id bigint, text string, person string").parquet(str(tmp_path / "in"))
    query = rowwise.clean_stream(stream).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    rows = {r["row_id"]: (r["text"], r["n_tokens"]) for r in spark.table("cleaned").collect()}
    assert rows[3] == ("apple pie", 2) and 4 not in rows and 5 not in rows

    replies = spark.createDataFrame([(0, [7, 8], "1: a|X (50%)", None)], "batch_id bigint, members array<bigint>, response string, error string")
    replies.write.parquet(str(tmp_path / "replies"))
    stream = spark.readStream.schema(replies.schema).parquet(str(tmp_path / "replies"))
    query = rowwise.parse_stream(stream).writeStream.format("memory").queryName("parsed").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["row_id"], r["status"]) for r in spark.table("parsed").collect()} == {(7, "ok"), (8, "padded")}


def test_from_a_file_to_folders(spark, tmp_path):
    from themeloom.plans.files import analyze_file

    source = tmp_path / "answers.csv"
    source.write_text("person,answer\n" + "".join(f"p{i},{t or ''}\n" for i, t in enumerate(TEXTS)))
    out = str(tmp_path / "out")
    options = Options(batch_size=2, final_theme_count=2)
    run = analyze_file(spark, str(source), out, fake_model, "answer", options, as_of=as_of(), schema="person string, answer string")
    results = spark.read.csv(f"{out}/results", header=True, multiLine=True, escape='"')
    assert {r["answer"]: r["consolidated_themes"] for r in results.collect()}["apple pie"] == "Group one, Group two"
    counts = spark.read.csv(f"{out}/theme_counts", header=True)
    assert {r["theme"] for r in counts.filter("stage = 'consolidated'").collect()} == {"Group one", "Group two"}
    facts = spark.read.json(f"{out}/run").first()
    assert facts["input"] == str(source) and facts["load_report"]["original_row_count"] == 9
    assert facts["load_report"]["cleaned_row_count"] == 6 and '"final_theme_count": 2' in facts["settings"]
    assert spark.read.json(f"{out}/statistics/section=analysis_summary").count() == 1
    assert facts["input_bytes"] == source.stat().st_size
    metrics = {r["metric"]: r["value"] for r in spark.read.csv(f"{out}/summary", header=True).collect()}
    assert metrics["Total Entries Processed"] == str(run.results.filter("status != 'error'").count()) and len(metrics) == 16
    assert spark.read.csv(f"{out}/theme_quality", header=True).filter("theme = 'apple'").first()["status"] in ("ok", "review")
    assert spark.read.json(f"{out}/analysis_summary").first()["theme_stats"]["themes_merged"] == 1


def test_merges_by_name_and_by_embedding_and_a_hierarchy(spark, tmp_path):
    from themeloom.plans.files import analyze_file

    source = tmp_path / "answers.csv"
    texts = ["apple pie", "Apple tart", "zebra fish", "mango lassi", "kiwi cake", "cake pie"]
    source.write_text("person,answer\n" + "".join(f"p{i},{t}\n" for i, t in enumerate(texts)))

    def embed(names):
        # Baked things are alike, all others are not.
        order = ["tart", "apple", "zebra", "fish", "mango", "lassi", "kiwi", "pie"]
        return [[float(o == ("tart" if n == "cake" else n)) for o in order] for n in names]

    merges = spark.createDataFrame([("pie", "tart"), ("fish", "unknown"), ("lassi", "lassi")], "from_theme string, to_theme string")
    edges = spark.createDataFrame([("fruit", "apple"), ("fruit", "kiwi"), ("food", "fruit"), ("food", "cake")], "parent string, child string")
    out = str(tmp_path / "out")
    options = Options(batch_size=2, consolidate=False)
    run = analyze_file(
        spark, str(source), out, fake_model, "answer", options, as_of=as_of(), merges=merges, embeddings=embed, edges=edges, schema="person string, answer string"
    )
    # pie goes to tart by name, which then has two texts, as has cake; the one seen first stays.
    assert {r["theme"]: r["target"] for r in run.merge_map.collect()} == {"pie": "tart", "cake": "tart"}
    by_text = {r["answer"]: r["consolidated_themes"] or r["themes"] for r in analysis.result_table(run, Options(text_column="answer")).collect()}
    named = {r["row_id"]: r["themes"] for r in run.results.collect()}
    assert sorted(named.values()) == sorted([["apple", "tart"], ["apple", "tart"], ["zebra", "fish"], ["mango", "lassi"], ["kiwi", "tart"], ["tart"]])
    assert len(by_text) == 6
    counts = {r["theme"]: int(r["n_texts"]) for r in spark.read.csv(f"{out}/hierarchy", header=True).collect()}
    assert counts == {"fruit": 3, "apple": 2, "kiwi": 1, "food": 3, "cake": 0}
    assert spark.read.parquet(f"{out}/responses").count() == run.responses.count()
