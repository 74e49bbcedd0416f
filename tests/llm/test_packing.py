from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, as_rows, words
from themeloom.llm import packing


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 5))
def test_bounds_pad_least(lengths, buckets):
    distinct = sorted(set(lengths))
    rows = np.array([lengths.count(n) for n in distinct])
    ends = packing.best_bounds(np.array(distinct), rows, rows * np.array(distinct), buckets)
    inner = distinct[:-1]
    best = min(padding(lengths, (*c, distinct[-1])) for k in range(min(buckets, len(distinct))) for c in combinations(inner, k))
    assert padding(lengths, ends) == best and len(ends) <= buckets and ends[-1] == distinct[-1]


def check(rows, found, batch_tokens):
    """Every row once, buckets hold their lengths, batches are filled in the order of ids."""
    assert sorted((i, len(words(t))) for i, t, *_ in rows) == sorted((r["doc_id"], r["n_tokens"]) for r in found)
    ends = sorted({r["bucket"] for r in found})
    for end in ends:
        inside = sorted((r["doc_id"], r["n_tokens"], r["batch"], r["position"]) for r in found if r["bucket"] == end)
        size = max(1, batch_tokens // max(end, 1))
        for place, (_, n, batch, position) in enumerate(inside):
            assert n <= end and (batch, position) == divmod(place, size)
            assert not [e for e in ends if n <= e < end]


def test_edges(edge, clashing, empty):
    found = packing.pack(edge, batch_tokens=64, buckets=3).collect()
    check(EDGE, found, 64)
    assert as_rows(packing.pack(clashing, batch_tokens=64, buckets=3)) == sorted(map(tuple, found), key=repr)
    assert packing.pack(empty).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, packing.pack(docs).collect(), packing.BATCH_TOKENS)


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (None, None)], "doc_id bigint, text string")
    found = packing.pack(df, buckets=1, batch_tokens=4).collect()
    assert len(found) == 4 and sorted((r["batch"], r["position"]) for r in found) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_a_length_of_ones_own(edge):
    found = packing.pack(edge, length=F.length("text")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(t or "") for i, t, _ in EDGE}


def test_rounded_bounds_are_few_and_never_below(spark):
    lengths = [0, 1, 511, 512, 513, 514, 1023, 1025, 10**6 + 1, 2**40 + 1]
    found = spark.createDataFrame([(n,) for n in lengths], "n bigint").select("n", packing.bound_of(F.col("n")).alias("b")).collect()
    for r in found:
        assert r["b"] >= r["n"] and r["b"] - r["n"] <= r["n"] / 255 and (r["n"] > 511 or r["b"] == r["n"])
