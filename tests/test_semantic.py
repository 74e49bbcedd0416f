import numpy as np
import pytest

from themeloom.operators import semantic


def frame(spark, vectors):
    rows = [(i, n, None if v is None else [float(x) for x in v]) for i, (n, v) in enumerate(vectors)]
    return spark.createDataFrame(rows, "id bigint, n bigint, embedding array<double>")


def groups_by_force(vectors, threshold):
    """Components over all pairs."""
    x = np.array([v for _, v in vectors], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    alike = x @ x.T >= threshold
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.where(alike, low[None, :], len(x)).min(axis=1)
    out = {}
    for g in set(low):
        members = [i for i in range(len(x)) if low[i] == g]
        if len(members) > 1:
            best = max(members, key=lambda i: (vectors[i][0], -i))
            out.update({i: best for i in members})
    return out


@pytest.mark.parametrize("seed, per_pivot, chunk", [(0, 5000, 1024), (1, 8, 5), (2, 20, 1024), (3, 6, 16)])
def test_equals_all_pairs(spark, monkeypatch, seed, per_pivot, chunk):
    monkeypatch.setattr(semantic, "CHUNK", chunk)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 6))
    points = [centres[rng.integers(9)] + rng.normal(scale=rng.choice([0.05, 0.4, 0.9]), size=6) for _ in range(150)]
    points += points[:10]  # copies
    vectors = [(int(rng.integers(1, 5)), p) for p in points]
    for threshold in (0.85, 0.97):
        got = {r["id"]: r["target"] for r in semantic.similar_themes(frame(spark, vectors), threshold, vectors_per_pivot=per_pivot).collect()}
        assert got == groups_by_force(vectors, threshold)


def test_missing_and_zero_vectors_stay_alone(spark):
    vectors = [(1, [1, 0]), (5, [2, 0]), (1, None), (1, [0, 0]), (1, [0, 1])]
    got = {r["id"]: r["target"] for r in semantic.similar_themes(frame(spark, vectors)).collect()}
    assert got == {0: 1, 1: 1}


def test_long_chains_connect(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(101, 100)], "a bigint, b bigint")
    groups = {r["id"]: r["group"] for r in semantic.connected_groups(links).collect()}
    assert groups == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def staged_rows(monkeypatch, module):
    """The row counts of the tables that ``module`` stages from now on."""
    counts, stage = [], module.stage

    def counted(df):
        stored = stage(df)
        counts.append(stored.count())
        return stored

    monkeypatch.setattr(module, "stage", counted)
    return counts


def test_many_cells_move_a_vector_once(spark, monkeypatch):
    """In many dimensions nearly all cells must be visited; vectors are not copied to them."""
    vectors = [(1, v) for v in np.random.default_rng(4).normal(size=(300, 48))]
    counts = staged_rows(monkeypatch, semantic)
    got = {r["id"]: r["target"] for r in semantic.similar_themes(frame(spark, vectors), 0.4, vectors_per_pivot=3).collect()}
    assert got == groups_by_force(vectors, 0.4) and len(got) > 100
    # Links between a few vectors come twice as often as vectors, once for each of their ends.
    assert max(counts) <= 2 * len(vectors)


def test_clusters_are_pruned_and_dense_ones_connect(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 6))
    vectors = [(1, centres[i % 5] + rng.normal(scale=0.03, size=6)) for i in range(200)]
    got = {r["id"]: r["target"] for r in semantic.similar_themes(frame(spark, vectors), 0.97, vectors_per_pivot=4).collect()}
    assert got == groups_by_force(vectors, 0.97) and len(set(got.values())) == 5
    x = np.array([v / np.linalg.norm(v) for _, v in vectors])
    pivots = x[:5]
    home = (x @ pivots.T).argmax(axis=1)
    radius = np.sqrt(2 - 2 * 0.97)
    some = semantic._neighbours(pivots, radius)(x[home == 0], home[home == 0], home[home == 1])
    assert not some.any()


def test_vectors_without_an_id_link_nothing(spark):
    df = spark.createDataFrame([(None, 1, [1.0, 0.0]), (2, 1, [1.0, 0.1]), (3, 1, [0.0, 1.0])], "id bigint, n int, embedding array<double>")
    assert semantic.similar_themes(df).collect() == []


def test_chunks_of_a_cell_meet_without_a_shuffle(spark, monkeypatch):
    """Blocks of a cell are read by the tasks that compare them; no vector is copied for each block it meets."""
    monkeypatch.setattr(semantic, "CHUNK", 10)
    vectors = [(1, v) for v in np.random.default_rng(9).normal(size=(100, 8))]
    links = semantic.similarity_links(frame(spark, vectors).select("id", "embedding"), 0.8)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
