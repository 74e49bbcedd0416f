import pytest
from pyspark.sql import functions as F

from themeloom.llm.sampling import smallest


@pytest.mark.parametrize("n, total", [(0, 5000), (10, 5000), (10, 10**9), (4000, 5000), (6000, 5000), (10, 1), (10, 0)])
def test_the_smallest_hashes(spark, n, total):
    rows = spark.range(5000).withColumn("rank", F.xxhash64("id"))
    found = [r["id"] for r in smallest(rows, "rank", n, total, "id").collect()]
    wanted = sorted(rows.collect(), key=lambda r: (r["rank"], r["id"]))[:n]
    assert found == [r["id"] for r in wanted]


def test_ties_and_no_rows(spark):
    rows = spark.range(50).withColumn("rank", F.lit(5).cast("bigint"))
    assert [r["id"] for r in smallest(rows, "rank", 3, 50, "id").collect()] == [0, 1, 2]
    assert smallest(rows.limit(0), "rank", 3, 0, "id").collect() == []
