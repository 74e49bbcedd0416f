import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGE, as_rows
from themeloom.llm import line_dedup as ld


def sets_of(rows):
    import re

    found = []
    for doc_id, text, *_ in rows:
        for line_no, line in enumerate((text or "").split("\n")):
            w = [x for x in re.split("[ \t-\r]+", line.lower()) if x]
            if w:
                found.append(((doc_id, line_no), " ".join(w), frozenset(w)))
    return sorted(found)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def check(rows, got, threshold=0.8):
    """The removed lines are exactly those an earlier line matches, and each names an earlier match."""
    lines = sets_of(rows)
    words = {k: w for k, _, w in lines}
    removed = {b for j, (b, _, wb) in enumerate(lines) if any(jaccard(wa, wb) >= threshold - 1e-12 for _, _, wa in lines[:j])}
    assert {(r["doc_id"], r["line_no"]) for r in got} == removed
    assert len(got) == len(removed)
    for r in got:
        line, keep = (r["doc_id"], r["line_no"]), (r["keep_doc_id"], r["keep_line_no"])
        assert keep < line and abs(r["jaccard"] - jaccard(words[keep], words[line])) < 1e-9 and r["jaccard"] >= threshold - 1e-9


def test_edges(edge, clashing, empty):
    check(EDGE, ld.repeated_lines(edge).collect())
    assert as_rows(ld.repeated_lines(clashing)) == as_rows(ld.repeated_lines(edge))
    assert ld.repeated_lines(empty).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, ld.repeated_lines(docs).collect())


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_families_of_near_copies(spark, threshold):
    """Lines of a small alphabet: many partners at every distance, ties of rarity, one word per line."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = rng.choice(["a b c d e f g h i j", "k l m n o p", "q r", "s", "a b c d e k l m n o p q r s t u v w x y z"]).split()
        lines = []
        for _ in range(3):
            w = [x if rng.random() > 0.08 else rng.choice("abcdefgh") for x in base]
            rng.shuffle(w)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(rows, ld.repeated_lines(df, threshold=threshold).collect(), threshold)


@pytest.mark.parametrize("short", [0, 1, 3, 1000])
def test_long_and_short_lists_remove_the_same(spark, short):
    """Families of near-copies with every share of long lists."""
    base = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(base[: 10 + i % 3] + [f"x{i % 4}"]) + f"\n{chr(97 + i % 5)} b c d e f g h i j") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(rows, ld.repeated_lines(df, short=short).collect())


def test_few_slots_change_nothing(spark):
    rows = [(i, f"one two three four five six seven eight nine w{i // 2}\nother line {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_rows(ld.repeated_lines(df, slots=2)) == as_rows(ld.repeated_lines(df))


def test_missing_and_repeated_ids(spark):
    rows = [(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, "C  b a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_rows(ld.repeated_lines(df), "doc_id", "line_no", "keep_doc_id") == [(3, 0, 2)]


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60), st.integers(1, 60), st.sampled_from([0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))
def test_the_bounds_lose_no_pair(a, b, threshold):
    """The least overlap and the prefix length, against Jaccard itself."""
    import math

    least = math.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)
    for common in range(min(a, b) + 1):
        similar = common / (a + b - common) >= threshold - 1e-12
        assert not similar or (common >= least and min(a, b) >= max(a, b) * threshold - 1e-9)
        for n in (a, b):
            # So many words outside the prefix cannot hold the whole overlap.
            assert not similar or n - (n - math.ceil(n * threshold - 1e-9) + 1) < common


def test_long_lines(spark):
    """Lines with more words than the narrow signature serves, near and far from one another."""
    rows = [(i, " ".join(f"w{k + (i % 2) * 50}" for k in range(150 + i)) + f" x{i}") for i in range(8)]
    rows += [(20 + i, " ".join(f"w{k}" if k % 9 > i else f"y{k}" for k in range(160))) for i in range(4)]
    check(rows, ld.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())


def test_long_lines_far_apart_are_no_candidates(spark, monkeypatch):
    """Lines that share many words but do not match are told apart before any is verified."""
    import random

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rng.sample(vocabulary, 140))) for i in range(60)] + [(60, "x " + " ".join(f"w{k}" for k in range(140)))]
    rows.append((61, rows[60][1] + " y"))
    verified, seen = ld.verified, []
    monkeypatch.setattr(ld, "verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))
    check(rows, ld.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert sum(seen) == 1
