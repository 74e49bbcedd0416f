import numpy as np
import pytest
import xxhash

from tests.llm.conftest import EDGE, as_rows, words
from themeloom.llm import simhash_dedup as sh
from themeloom.llm.components import components


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and label[b] > label[a]:
                    label[b], changed = label[a], True
    return label


def expected(rows):
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    label = brute_components(fps)
    return sorted(((i, f"{fps[i]:016x}", label[i]) for i in fps), key=repr)


def test_groups_agree_with_brute_force(edge, clashing):
    assert as_rows(sh.near_groups(edge)) == expected(EDGE)
    assert as_rows(sh.near_groups(clashing)) == expected(EDGE)


def test_given_documents_agree_with_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(sh.near_groups(docs)) == expected(rows)


@pytest.mark.parametrize("weight", range(7))
def test_pairs_are_found_whichever_bits_differ(spark, weight):
    """Pairs at each distance over random bits: all up to 4, none beyond."""
    rng = np.random.default_rng(weight)
    pairs = []
    for _ in range(150):
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        b = a
        for bit in rng.choice(64, weight, replace=False):
            b ^= 1 << int(bit)
        pairs.append((a, b))
    signed = [int(np.uint64(x).astype(np.int64)) for p in pairs for x in p]
    fps = spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp bigint")
    found = {tuple(r) for r in sh.close_pairs(fps).collect()}
    wanted = {(min(x, y), max(x, y)) for x, y in zip(signed[::2], signed[1::2]) if x != y}
    assert found == (wanted if weight <= 4 else set())


def test_blocks_are_checked():
    sh.check_blocks(sh.BLOCKS, 4)
    with pytest.raises(ValueError, match="shares"):
        sh.check_blocks(sh.BLOCKS, 5)
    with pytest.raises(ValueError, match="cut"):
        sh.check_blocks(sh.BLOCKS[:2] + (sh.Block(42, 21, 3, 4),), 4)
    assert 30 < sh.replicas() < 31


def test_every_word_has_its_home_and_all_anchors_in_reach():
    block = sh.Block(0, 9, 1, 3)
    near, home = sh.patterns(block, 2), sh.patterns(block, 1)
    for word in range(1 << 9):
        syndrome = sh._syndrome_of(word, 7)
        anchors = {word ^ p for p in near[syndrome]}
        assert anchors == {c for c in range(1 << 9) if sh._syndrome_of(c, 7) == 0 and (c ^ word).bit_count() <= 2}
        assert any(sh._syndrome_of(word ^ p, 7) == 0 for p in home[syndrome])


def test_rows_without_an_id_and_repeated_rows(spark):
    df = spark.createDataFrame([(5, "a"), (5, "a"), (3, "a"), (None, "a"), (None, "b c d")], "doc_id bigint, text string")
    found = as_rows(sh.near_groups(df), "doc_id", "component_id")
    assert found == sorted([(5, 3), (5, 3), (3, 3), (None, 3), (None, None)], key=repr)


def test_an_empty_table(empty):
    assert sh.near_groups(empty).collect() == []


def test_first_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "one two"), (1, "ONE  two"), (2, "others here")], "doc_id bigint, text string")
    assert as_rows(sh.drop_near_copies(df), "doc_id") == [(1,), (2,)]


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7), (300, 300), (None, 4)]
    found = dict(as_rows(components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
