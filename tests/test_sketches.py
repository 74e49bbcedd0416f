import random

import pytest
from pyspark.sql import functions as F

from themeloom.operators import sketches, themes, tokens


def tables(spark, rows):
    counted = spark.createDataFrame([(i, n) for i, n, _ in rows], "row_id bigint, n_tokens bigint")
    occ = spark.createDataFrame([(i, t) for i, _, ts in rows for t in ts], "row_id bigint, theme string")
    return counted, occ


def some_rows(seed, n):
    rng = random.Random(seed)
    return [(i, int(rng.lognormvariate(5, 1.5)), [f"theme {int(rng.paretovariate(0.4)) % 9000}" for _ in range(rng.randint(0, 4))]) for i in range(n)]


@pytest.mark.parametrize("n", [1, 40, 6000])
def test_merged_runs_keep_to_their_bounds(spark, n):
    rows = some_rows(n, n)
    runs = [sketches.run_sketches(*tables(spark, rows[k::3]), run=k) for k in range(3)]
    merged = sketches.merge_sketches(runs[0].unionByName(runs[1]).unionByName(runs[2]))
    again = sketches.merge_sketches(sketches.merge_sketches(runs[0].unionByName(runs[2])).unionByName(runs[1].drop("run")))
    counted, occ = tables(spark, rows)
    exact = tokens.token_distribution(counted).first()
    distinct = len({t for _, _, ts in rows for t in ts})
    for some in (merged, again):
        found = sketches.sketched_distribution(some)
        row = found.first()
        for c in ("total_texts", "total_tokens", "min_tokens", "max_tokens", "mean_tokens"):
            assert row[c] == exact[c]
        assert row["total_occurrences"] == occ.count()
        checked = sketches.bounds_check(found, tokens.token_histogram(counted), F.lit(distinct)).collect()
        assert len(checked) == 6 and all(r["within"] for r in checked), checked


def test_the_check_sees_what_is_off(spark):
    counted, occ = tables(spark, [(i, i, ["a"]) for i in range(1000)])
    found = sketches.sketched_distribution(sketches.run_sketches(counted, occ, 0)).withColumn("p25", F.lit(290)).withColumn("unique_themes", F.lit(2))
    checked = {r["measure"]: r["within"] for r in sketches.bounds_check(found, tokens.token_histogram(counted), F.lit(1)).collect()}
    assert checked == {"median_tokens": True, "p25": False, "p75": True, "p90": True, "p95": True, "unique_themes": False}
    assert sketches.sketched_distribution(sketches.run_sketches(counted.limit(0), occ.limit(0), 0)).count() == 0
