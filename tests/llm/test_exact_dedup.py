from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, as_rows, sha, squeezed
from themeloom.llm import exact_dedup

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[squeezed(text)].append(doc_id)
    return sorted(
        ((i, min(ids), len(ids), i == min(ids), sha(text)) for text, ids in groups.items() for i in ids), key=repr
    )


def test_groups_agree_with_the_rule(edge, clashing):
    assert as_rows(exact_dedup.exact_groups(edge), *COLUMNS) == expected(EDGE)
    assert as_rows(exact_dedup.exact_groups(clashing), *COLUMNS) == expected(EDGE)


def test_an_index_of_tiny_buckets_gives_the_same(edge):
    assert as_rows(exact_dedup.exact_groups(edge, capacity=1), *COLUMNS) == expected(EDGE)


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a  b"), (None, "a b"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = as_rows(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "kept")
    assert found == sorted([(1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (None, None, 1, True)], key=repr)


def test_rows_that_stay_and_sizes_come_from_the_index(spark, edge, monkeypatch):
    """An index with other ids and sizes in its chains gives other groups, under hashes that several rows have."""
    build = exact_dedup.build_index
    altered = lambda *args: build(*args).selectExpr("h", "sha", "rows", "keep_id + 100 as keep_id", "n * 10 as n")
    monkeypatch.setattr(exact_dedup, "build_index", altered)
    found = as_rows(exact_dedup.exact_groups(edge), "doc_id", "keep_id", "group_size")
    wanted = [(i, k + 100, n * 10) if n > 1 else (i, k, n) for i, k, n, *_ in expected(EDGE)]
    assert found == sorted(wanted, key=repr)


def test_two_texts_of_one_digest_are_an_error(spark, monkeypatch):
    """The bytes are compared: with a digest that tells nothing, rows of one hash must not pass for copies."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda *_: F.lit("00"))
    with pytest.raises(Exception, match="two different texts have the same SHA-256"):
        exact_dedup.exact_groups(df).collect()


def test_a_hash_shared_by_two_texts_is_one_chain_of_two_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id bigint, text string")
    found = as_rows(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size")
    assert found == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_a_hot_text_keeps_its_first_row(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 > 0 then 'same  text' else concat('t', id) end as text")
    kept = exact_dedup.drop_copies(df)
    assert kept.count() == 1001 and kept.filter("text like 'same%'").collect()[0]["doc_id"] == 1


def test_an_empty_table(empty):
    assert exact_dedup.exact_groups(empty).collect() == []
    assert exact_dedup.drop_copies(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 65535), st.integers(1, 9), max_size=60), st.integers(1, 12))
def test_directory_splits_only_overfull_buckets(counts, capacity):
    slots = exact_dedup.directory(counts, capacity)
    assert set(slots) == set(counts)
    held = defaultdict(int)
    for slot, (depth, prefix) in slots.items():
        assert slot >> (16 - depth) == prefix
        held[depth, prefix] += counts[slot]
    for (depth, prefix), n in held.items():
        assert n <= capacity or depth == 16
        # The bucket it was split from was overfull.
        if depth:
            assert sum(c for s, c in counts.items() if s >> (17 - depth) == prefix >> 1) > capacity
