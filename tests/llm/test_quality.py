import random
import zlib

import numpy as np
import pandas as pd
import pytest

from themeloom.llm import quality

FOLDER = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "held_out", "score", "predicted").collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="module")
def scored(tables):
    return rows(quality.classify(*tables))


def test_held_out_labels(tables, scored):
    docs, labels = tables
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(s, known[d], p) for d, out, s, p in scored if out and d in known]
    assert len(scored) == docs.count() and all(0 <= s <= 1 and p == (s >= 0.3) for _, _, s, p in scored)
    assert all(out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, out, _, _ in scored)
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert len(bad) > 5
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert np.mean([p == y for _, y, p in held]) > 0.93


def test_rows_may_be_dealt_anyhow(tables, scored):
    docs, labels = tables
    assert rows(quality.classify(docs.repartition(7, "lang"), labels.repartition(3))) == scored


def test_labels_held_out_and_other_columns_do_not_matter(spark, tables, scored):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    other = docs.selectExpr("doc_id", "text", "'x' as lang", "'x' as source", "0.0 as score", "1 as fold", "1 as x", "1 as y", "1 as predicted")
    assert rows(quality.classify(other, flipped)) == scored


def test_normal_equations_and_ridge():
    rng = np.random.default_rng(1)
    size = len(quality.STATISTICS)
    x = rng.integers(0, 1 << 18, (500, size))
    of = quality.Kernel(x.mean(0) / 65536, x.std(0) / 65536, rng.standard_normal((size, 30)) / 4, rng.uniform(0, 6, 30))
    y = (x[:, 0] > x[:, 1]).astype(float)
    table = pd.DataFrame({"fold": rng.integers(1, 5, 500), "x": list(x), "y": y})
    whole = list(quality._add_rows(quality._sums(of)(iter([table]))))[0]
    parts = [p for i in range(0, 500, 60) for p in quality._sums(of)(iter([table[i : i + 60]]))]
    split = list(quality._add_rows(iter(parts)))[0]
    keys = lambda t: {(f, r): list(s) for f, r, s in zip(t["fold"], t["row"], t["sums"])}
    assert keys(whole) == keys(split)
    matrix = np.zeros((31, 32), np.int64)
    for f, r, s in zip(whole["fold"], whole["row"], whole["sums"]):
        matrix[r] += s
    z = of.features(x) / (1 << 15)
    direct = np.linalg.solve(z.T @ z + quality.RIDGE * 500 * np.eye(31), z.T @ y)
    assert np.allclose(quality.solve(matrix), direct, atol=1e-6)
    assert quality.solve(np.zeros((31, 32), np.int64)).tolist() == [0] * 31


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    size = len(quality.STATISTICS)
    of = quality.Kernel(np.zeros(size), np.ones(size), rng.standard_normal((size, 20_000)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, 20_000))
    x = rng.standard_normal((6, size))
    z = of.features(np.round(x * 65536))[:, :-1] / (1 << 15)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / quality.WIDTH**2)
    assert np.abs(2 * (z @ z.T) / 20_000 - exact).max() < 0.05


def test_isotonic_against_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        bins = {b: (n, rng.randint(0, n)) for b in rng.sample(range(100), rng.randint(1, 12)) for n in [rng.randint(1, 9)]}
        at, share = quality.isotonic(bins)
        order = sorted(bins)
        n, ones = np.array([bins[b][0] for b in order]), np.array([bins[b][1] for b in order])
        # The largest over starts of the smallest over ends of the means between them.
        best = [max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(order))) for i in range(k + 1)) for k in range(len(order))]
        levels = sorted(set(np.round(best, 12)))
        pools = [([k for k, v in enumerate(best) if abs(v - level) < 1e-9]) for level in levels]
        assert np.allclose(at, [(n[p] * np.array(order)[p]).sum() / n[p].sum() for p in pools])
        assert np.allclose(share, np.maximum.accumulate([(ones[p].sum() + 0.5) / (n[p].sum() + 1) for p in pools]))


def test_edges(spark, edge, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(1, None), (99, 1), (None, 1), (2, 0)], "doc_id bigint, quality int")
    found = rows(quality.classify(edge, labels))
    assert sorted(d for d, *_ in found) == list(range(1, 13))
    by_id = {d: s for d, _, s, _ in found}
    assert by_id[2] == by_id[3] and by_id[8] == by_id[9]
    extra = clashing.selectExpr("*", "1 as fold", "1 as x", "1 as y", "1 as doc")
    assert rows(quality.classify(extra, labels)) == found
    assert quality.classify(empty, labels).count() == 0
    assert {s for _, _, s, _ in rows(quality.classify(edge, labels.limit(0)))} == {0.5}
    assert {s for _, _, s, _ in rows(quality.classify(edge, labels.selectExpr("doc_id", "cast(null as int) as quality")))} == {0.5}
    repeated = edge.unionByName(edge).unionByName(edge.selectExpr("cast(null as bigint) as doc_id", "text", "lang"))
    again = quality.classify(repeated, labels)
    assert again.count() == 36 and again.filter("doc_id is null and held_out").count() == 12


def test_statistics_of_long_and_odd_texts():
    assert quality.statistics(None) == quality.statistics("")
    for text in ["\udcff x", "a" * 3_000_000, "a " * 1_000_000, "\n" * 100, "\U0001f600"]:
        assert len(quality.statistics(text)) == len(quality.STATISTICS) and np.isfinite(quality.statistics(text)).all()
