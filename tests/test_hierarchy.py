import random

import pytest

from themeloom.operators import hierarchy


def brute_closure(edges):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
        if not more:
            return reach
        reach |= more


def table(spark, edges):
    return spark.createDataFrame(list(edges), "parent string, child string")


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("n", [1, 2, 5, 16, 37])
def test_a_chain_of_any_length(spark, n):
    chain = [(f"t{i:02}", f"t{i + 1:02}") for i in range(n)]
    assert pairs(hierarchy.closure(table(spark, chain))) == {(f"t{i:02}", f"t{j:02}") for i in range(n) for j in range(i + 1, n + 1)}
    assert hierarchy.cycles(hierarchy.closure(table(spark, chain))).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_graphs_with_cycles_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(12)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(3, 16))]
    reach = brute_closure(edges)
    found = hierarchy.closure(table(spark, [*edges, *edges, (None, "t1"), ("t1", None)]))
    assert pairs(found) == reach
    assert pairs(hierarchy.cycles(found)) == {(a, min(d for c, d in reach if c == a and (d, a) in reach)) for a, b in reach if a == b}
    occ = [(rng.randint(0, 9), rng.choice([*names, "outside"])) for _ in range(40)]
    counts = {r["theme"]: (r["n_own"], r["n_texts"], r["n_below"]) for r in hierarchy.hierarchy_counts(spark.createDataFrame(occ, "row_id bigint, theme string"), table(spark, edges)).collect()}
    for theme in {t for e in edges for t in e}:
        below = {d for a, d in reach if a == theme} - {theme}
        own = {r for r, t in occ if t == theme}
        assert counts.pop(theme) == (len(own), len({r for r, t in occ if t in below} | own), len(below))
    assert counts == {}


def test_no_edges(spark):
    occ = spark.createDataFrame([(1, "a")], "row_id bigint, theme string")
    assert hierarchy.hierarchy_counts(occ, table(spark, [])).count() == 0
    assert [tuple(r) for r in hierarchy.hierarchy_counts(occ, table(spark, [("a", "a")])).collect()] == [("a", 1, 1, 0, "a")]
