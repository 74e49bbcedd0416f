import numpy as np
import pytest

from tests.test_semantic import frame, groups_by_force, staged_rows
from themeloom.operators import hyperplanes, semantic


def clustered(seed, n=200, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    points = [centres[rng.integers(12)] + rng.normal(scale=rng.choice([0.02, 0.2, 0.8]), size=dims) for _ in range(n)]
    return [(int(rng.integers(1, 5)), p) for p in points + points[:15]]


def lowest(links, n):
    """The lowest number each is connected with."""
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


@pytest.mark.parametrize("seed, chunk", [(0, 1024), (1, 7)])
def test_links_are_exact_and_nearly_all(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(semantic, "CHUNK", chunk)
    vectors = clustered(seed)
    x = np.array([v for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for threshold in (0.85, 0.97):
        links = {tuple(r) for r in hyperplanes.banded_links(frame(spark, vectors).select("id", "embedding"), threshold).collect()}
        pairs = [(a, b) for a in range(len(x)) for b in range(a) if x[a] @ x[b] >= threshold]
        exact, banded = lowest(pairs, len(x)), lowest(links, len(x))
        # A link may stand for a path within a bucket; it never joins what all pairs do not.
        assert links and all(exact[a] == exact[b] for a, b in links)
        assert np.mean([banded[a] == banded[b] for a, b in pairs]) >= 0.97


def test_with_full_recall_it_is_the_exact_search(spark):
    vectors = clustered(3, n=120)
    links = lambda v, t: hyperplanes.banded_links(v, t, recall=0.999999)
    got = {r["id"]: r["target"] for r in semantic.similar_themes(frame(spark, vectors), 0.9, links=links).collect()}
    assert got == groups_by_force(vectors, 0.9)


def test_a_crowd_costs_no_square(spark, monkeypatch):
    """Vectors within half the distance of a bucket's first are not compared with each other."""
    rng = np.random.default_rng(5)
    vectors = [(1, np.array([1.0, 0, 0, 0]) + rng.normal(scale=0.01, size=4)) for _ in range(500)]
    seen = []
    compared = hyperplanes.compared
    monkeypatch.setattr(hyperplanes, "compared", lambda placed, t: seen.append(placed) or compared(placed, t))
    links = hyperplanes.banded_links(frame(spark, vectors).select("id", "embedding"), 0.85)
    assert len({r["group"] for r in semantic.connected_groups(links).collect()}) == 1
    assert seen[0].filter("not visiting").count() == 0


def test_the_layout_follows_from_the_wanted_recall():
    for n in (1, 500, 10**6, 10**9):
        for threshold in (0.3, 0.85, 0.99, 1.0):
            bits, n_bands = hyperplanes.layout(n, threshold, 0.9)
            same = (1 - np.arccos(threshold) / np.pi) ** bits
            assert 1 - (1 - same) ** n_bands >= 0.9 - 1e-12 and 1 <= bits <= 30
    assert hyperplanes.layout(10**9, 0.85)[0] > hyperplanes.layout(10**4, 0.85)[0]


def test_measured_recall(spark):
    vectors = frame(spark, clustered(7)).select("id", "embedding")
    row = hyperplanes.recall_of(vectors, 0.85, vectors.filter("id % 3 = 0")).first()
    x = np.array([v for _, v in clustered(7)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert row["pairs"] == sum(x[a] @ x[b] >= 0.85 for a in range(0, len(x), 3) for b in range(len(x)) if a != b)
    assert 0.9 <= row["recall"] == row["found"] / row["pairs"] <= 1
    assert hyperplanes.recall_of(vectors.limit(0), 0.85, vectors).first()["recall"] == 1.0
    assert hyperplanes.banded_links(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 6])
def test_bands_and_large_buckets(spark, monkeypatch, chunk):
    """Bands are used where they are less work; buckets over the size of a block are compared in blocks."""
    monkeypatch.setattr(hyperplanes, "_COMPARED_A_MOVE", 4)
    monkeypatch.setattr(semantic, "CHUNK", chunk)
    vectors = clustered(11, n=150)
    assert hyperplanes.dealing(165, 0.85)[0] > 1
    x = np.array([v / np.linalg.norm(v) for _, v in vectors])
    links = [tuple(r) for r in hyperplanes.banded_links(frame(spark, vectors).select("id", "embedding"), 0.85).collect()]
    pairs = [(a, b) for a in range(len(x)) for b in range(a) if x[a] @ x[b] >= 0.85]
    exact, banded = lowest(pairs, len(x)), lowest(links, len(x))
    assert links and all(exact[a] == exact[b] for a, b in links)
    assert np.mean([banded[a] == banded[b] for a, b in pairs]) >= 0.95


def test_a_high_recall_at_a_low_threshold_does_not_copy_vectors(spark, monkeypatch):
    vectors = [(1, v) for v in np.random.default_rng(8).normal(size=(300, 48))]
    counts = staged_rows(monkeypatch, hyperplanes)
    links = lambda v, t: hyperplanes.banded_links(v, t, recall=0.999999)
    got = {r["id"]: r["target"] for r in semantic.similar_themes(frame(spark, vectors), 0.4, links=links).collect()}
    assert got == groups_by_force(vectors, 0.4)
    assert max(counts) <= len(vectors)
    # Bands come back where comparing all would be more work.
    assert hyperplanes.dealing(10**6, 0.85)[0] > 1 and hyperplanes.dealing(10**6, 0.4, 0.999999) == (0, 1)


def test_signatures_are_made_in_slices(spark, monkeypatch):
    """However many bands there are, a task makes few signatures at a time."""
    monkeypatch.setattr(hyperplanes, "_CELLS", 1 << 12)
    vectors = frame(spark, clustered(7)).select("id", "embedding")
    units = semantic.unit_vectors(vectors).coalesce(1)
    got = hyperplanes.signed(units, 8, 64).collect()
    taken = []

    class Frames:
        def mapInPandas(self, f, schema):
            taken.append(f)
            return self

        def select(self, *columns):
            return self

        def head(self):
            return {"n": 8}

    hyperplanes.signed(Frames(), 8, 64)
    rows = units.toPandas()
    parts = list(taken[0](iter([rows])))
    assert max(map(len, parts)) <= 8 and sum(map(len, parts)) == len(rows) == len(got)
    keys = {r["id"]: list(r["keys"]) for r in got}
    assert all(keys[i] == list(k) for part in parts for i, k in zip(part["id"], part["keys"]))


@pytest.fixture
def passes(spark, monkeypatch):
    """The partitions of each table that is mapped in Python from now on, by the columns made."""
    made = []
    kind = type(spark.range(1))
    run = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, f, schema, *a, **k: made.append((schema, self.rdd.getNumPartitions())) or run(self, f, schema, *a, **k))
    return made


def recalled_by_force(spark, vectors, threshold, asked):
    """``pairs, found`` over all pairs, from the keys of the search itself."""
    units = semantic.unit_vectors(vectors)
    rows = hyperplanes.signed(units, *hyperplanes.layout(units.count(), threshold)).collect()
    x, keys = np.array([r["vector"] for r in rows]), np.array([r["keys"] for r in rows])
    pairs = found = 0
    for i, r in enumerate(rows):
        if asked(r["id"]):
            alike = (x @ x[i] >= threshold) & np.array([o["id"] != r["id"] for o in rows])
            pairs, found = pairs + alike.sum(), found + (alike & (keys == keys[i]).any(axis=1)).sum()
    return pairs, found


def test_recall_is_counted_in_few_passes_by_many_tasks(spark, passes):
    """A block of queries is as large as memory allows, and a table in one piece is dealt to many tasks."""
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(2).normal(size=(2500, 4)))]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<double>").coalesce(1)
    row = hyperplanes.recall_of(vectors, 0.9, vectors).first()
    counted = [n for schema, n in passes if schema == "n long, shared long"]
    signing = [n for schema, n in passes if schema != "n long, shared long"]
    assert len(counted) == 1 and min(signing) >= 2
    assert (row["pairs"], row["found"]) == recalled_by_force(spark, vectors, 0.9, lambda i: True)


@pytest.mark.parametrize("cells, tile, stride, block", [(1 << 21, 1024, 128, 64 << 20), (50, 7, 3, 400), (1, 16, 8, 1)])
def test_recall_in_blocks_and_slices(spark, monkeypatch, passes, cells, tile, stride, block):
    for name, value in (("_CELLS", cells), ("_TILE", tile), ("_STRIDE", stride), ("_BLOCK_BYTES", block), ("_TASK", 40)):
        monkeypatch.setattr(hyperplanes, name, value)
    vectors = frame(spark, clustered(13, n=60)).select("id", "embedding")
    for threshold in (0.5, 0.9):
        row = hyperplanes.recall_of(vectors, threshold, vectors.filter("id % 10 = 0")).first()
        assert (row["pairs"], row["found"]) == recalled_by_force(spark, vectors, threshold, lambda i: i % 10 == 0)
    assert (len([s for s, _ in passes if s == "n long, shared long"]) > 2) == (block < 1000)


def test_rounding_does_not_move_a_pair_over_the_threshold(spark):
    angle = np.arccos(0.6)
    rows = [(0, [1.0, 0.0]), *[(i, [float(np.cos(angle + e)), float(np.sin(angle + e))]) for i, e in enumerate((-1e-9, 1e-9, -1e-12, 1e-12), 1)]]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    assert hyperplanes.recall_of(vectors, 0.6, vectors.filter("id = 0")).first()["pairs"] == 2


@pytest.mark.parametrize("bits", [0, 1, 8, 9, 16, 17, 30])
def test_signatures_are_the_same_stored_as_bytes(spark, bits):
    units = semantic.unit_vectors(frame(spark, clustered(17, n=20)).select("id", "embedding"))
    keys = {r["id"]: r["keys"] for r in hyperplanes.signed(units, bits, 3).collect()}
    planes = hyperplanes._planes(8, bits, 3, hyperplanes.SEED)
    kind = hyperplanes._number(bits)
    for r in hyperplanes._sealed(units, planes, bits, 3).collect():
        assert [int(k) + (band << bits) for band, k in enumerate(np.frombuffer(r["keys"], kind))] == keys[r["id"]]


def test_a_norm_is_worked_out_once_a_vector(spark):
    """A norm inside the lambda that divides by it would be worked out for each number."""
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, None]), (5, [])], "id bigint, embedding array<double>")
    units = semantic.unit_vectors(vectors)
    assert [tuple(r) for r in units.collect()] == [(1, [0.6, 0.8])]
    assert "/ SQRT(" not in units._jdf.queryExecution().optimizedPlan().toString()
