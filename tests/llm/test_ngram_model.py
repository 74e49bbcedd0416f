import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGE, as_rows, words
from themeloom.llm import elias_fano as ef
from themeloom.llm import ngram_model as ng


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63), max_size=300), st.lists(st.integers(0, 2**63), max_size=50), st.integers(0, 60))
def test_sequences_are_kept_and_searched(values, wanted, cut):
    values = np.array(sorted(v >> cut for v in values), np.uint64)
    s = ef.Sequence.build(values)
    assert (s[np.arange(len(values))] == values).all()
    wanted = np.array([v >> cut for v in wanted] + values.tolist(), np.uint64)
    assert (s.successor(wanted) == np.searchsorted(values, wanted)).all()


def test_files_are_mapped(tmp_path):
    values = np.arange(0, 5000, 7, dtype=np.uint64)
    ef.save(str(tmp_path / "f"), {"s": ef.Sequence.build(values)}, {"a": np.arange(3, dtype=np.uint16)}, {"k": 5})
    sequences, arrays, facts = ef.load(str(tmp_path / "f"))
    assert (sequences["s"][np.arange(len(values))] == values).all() and arrays["a"].tolist() == [0, 1, 2] and facts == {"k": 5}
    assert [p.name for p in tmp_path.iterdir()] == ["f"]


def brute_base(rows):
    learn = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in [*words(t), "\n"])
    total, size = sum(learn.values()), len(learn)
    out = {}
    for i, t in rows:
        tokens = [*words(t), "\n"]
        base = sum(math.log10((learn[w] + 0.1) / (total + 0.1 * (size + 1))) for w in tokens)
        out[i] = (len(tokens), sum(learn[w] > 0 for w in tokens), total, base)
    return out


def check(found, rows):
    wanted = brute_base(rows)
    assert len(found) == len(rows)
    for r in found:
        n, known, total, base = wanted[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


@pytest.mark.parametrize("order, shard_tokens", [(2, 1000), (3, 1000), (3, 10**6)])
def test_edges(edge, clashing, empty, tmp_path, order, shard_tokens):
    found = ng.score_documents(edge, str(tmp_path / "a"), order=order, shard_tokens=shard_tokens)
    check(found.collect(), [r[:2] for r in EDGE])
    again = ng.score_documents(clashing, str(tmp_path / "b"), order=order, shard_tokens=shard_tokens)
    assert as_rows(again) == as_rows(found)
    assert ng.score_documents(empty, str(tmp_path / "c")).collect() == []


def test_held_out_documents_score_above_the_base(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = ng.score_documents(docs, str(tmp_path / "m"), shard_tokens=50_000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = found.collect()
    check(got, rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_follow_the_smoothing(spark, tmp_path, order):
    """Against plain dictionaries, over several shards; and the words of a context sum to one at most."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.6, 40) if k < 40) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    facts = ng.train(df, str(tmp_path / "m"), order=order, shard_tokens=200)
    model = ng.Model(*facts)
    assert len(model.shards) > 3
    counted = Counter(h for t in texts for h in ng.tokens(t))
    v, n = len(counted), sum(counted.values())
    single = {h: (counted[h] + 0.1) / (n + 0.1 * (v + 1)) for h in counted}
    pairs = Counter(p for t in texts for p in zip(ng.tokens(t), ng.tokens(t)[1:]))
    known = list(counted)
    for context in sorted(counted, key=counted.get)[-4:]:
        if context == ng.END:
            continue
        probabilities = {}
        for w in known:
            row = model.score([[context, w]])
            probabilities[w] = 10 ** (row["score"][0] - math.log10(single[context]))
        total = sum(probabilities.values())
        assert 0.97 < total <= 1 + 1e-6
        seen = [w for w in known if pairs[context, w]]
        unseen = [w for w in known if not pairs[context, w]]
        # Unseen words share what is left in proportion to their base.
        ratios = [probabilities[w] / single[w] for w in unseen]
        assert max(ratios) / min(ratios) < 1.0001
        assert all(probabilities[w] > ratios[0] * single[w] for w in seen)


def test_nothing_to_learn_from(spark, tmp_path):
    df = spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")
    row = ng.score_documents(df, str(tmp_path / "m")).collect()[0]
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (True, 3, 0, 0)
    assert row["score"] == row["base_score"]


def test_a_folder_that_cannot_be_mapped_is_refused():
    with pytest.raises(ValueError, match="all machines can open"):
        ng.local_path("hdfs://store/x")
    assert ng.local_path("file:///a/b") == "/a/b"
