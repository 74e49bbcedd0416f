import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from themeloom.operators import cleaning
from themeloom.streaming import firsts

START = datetime(2024, 1, 31, 12)
SCHEMA = "row_id bigint, text string, at timestamp, score double, tags array<string>"


def row(i, text, seconds):
    return (i, text, START + timedelta(seconds=seconds, microseconds=17), i / 3, [f"t{i}", None])


def streamed(spark, folder, *batches, lateness="10 seconds"):
    """The result of a stream that gets each list of rows as a micro-batch, and then one from much later."""
    closing = [(10**9, "the closing row", START + timedelta(days=1), 0.0, [])]
    seen = []
    os.makedirs(f"{folder}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    found = firsts.first_copies(stream, lateness, "at")
    for k, rows in enumerate([*batches, closing]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = found.writeStream.option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{folder}/out")
        query.awaitTermination(120)
        seen.append(sorted(r["row_id"] for r in spark.read.schema(SCHEMA).parquet(f"{folder}/out").collect()))
    return spark.read.schema(SCHEMA).parquet(f"{folder}/out").filter("row_id < 1000000000"), seen


def test_copies_across_micro_batches_as_in_a_batch(spark, tmp_path):
    rng = random.Random(1)
    texts = [f"text number {i % 9}" for i in range(60)] + ["  text number 3\t", None, "   ", "no", "text number 77 "]
    rows = [row(i, t, i // 20) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    found, seen = streamed(spark, str(tmp_path), rows[:30], rows[30:])
    batch = cleaning.clean_texts(spark.createDataFrame(rows, SCHEMA)).drop("idx")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
    # Nothing goes on before its time is past.
    assert seen[0] == seen[1] == [] and len(seen[2]) == 10


def test_the_lateness_decides(spark, tmp_path):
    first = [row(5, "a common text", 0), row(6, "another text", 0)]
    second = [row(2, "a common text", 8), row(9, "another text", 9)]
    third = [row(20, "a later text", 100)]
    # Row 1 has the smallest id, but comes when its text has gone on.
    fourth = [row(1, "a common text", 101), row(21, "a later text", 102), row(22, "much too late", 3)]
    found, seen = streamed(spark, str(tmp_path), first, second, third, fourth)
    assert seen == [[], [], [2, 6], [2, 6], [2, 6, 20]]
    assert {r["row_id"]: r["text"] for r in found.collect()} == {2: "a common text", 6: "another text", 20: "a later text"}


def test_the_plan_keeps_state_by_digest(spark, tmp_path):
    spark.createDataFrame([row(1, "some text", 0)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = firsts.first_copies(stream, "1 hour", "at").writeStream.format("memory").queryName("planned").start()
    query.processAllAvailable()
    plan = query._jsq.explainInternal(False)
    query.stop()
    assert "FlatMapGroupsInPandasWithState" in plan and plan.index("Exchange hashpartitioning(digest") < plan.index("MapInPandas")
    assert "EventTimeWatermark" in plan


def test_a_hot_text_is_reduced_before_the_shuffle(spark, tmp_path):
    rows = [row(i, "the hot text", 0) for i in range(3000)] + [row(i, f"text {i}", 0) for i in range(3000, 3010)]
    stream = spark.createDataFrame(rows, SCHEMA)
    narrow = stream.select(F.col("text").alias("digest"), "row_id", F.col("at").alias("time"), F.lit("{}").alias("row")).coalesce(2)
    reduced = narrow.mapInPandas(firsts._one_of_each, firsts._WAITING)
    assert reduced.count() <= 30 and reduced.filter("digest = 'the hot text'").agg(F.min("row_id")).first()[0] == 0
