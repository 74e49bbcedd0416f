import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from themeloom.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """The rule restated with Python integers."""
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t, Counter(t)) for d, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t, _ in held)
    df = {}
    for _, _, counts in held:
        for w in counts:
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, t, counts in held:
            m = 75 + 25 * len(t) * n_docs // length
            score = 0
            for w, repeats in Counter(terms(text)).items():
                tf = counts[w]
                score += repeats * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(w, 0) + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1):
            out.append((item, rank, d, -score))
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in lexical_search.top_documents(d, i, **options).collect()), key=repr)


def some_texts(seed, n, vocabulary=60, longest=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary - 4)] + ["Été", "İx", "a_b", "x-Y"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, longest)))) for i in range(n)]


def test_terms():
    text = "Don't STOP, café au lait_2 ÀB\x7fc d \x00e"
    assert [t.decode() for t in lexical_search.terms_of(text)] == terms(text)
    assert lexical_search.terms_of(None) == lexical_search.terms_of(" ,.!") == []
    assert len(lexical_search.terms_of("y" * 1000)[0]) == 33


@pytest.mark.parametrize("options", [{}, {"items_per_block": 3}, {"terms_per_block": 10}, {"k": 1}])
def test_against_brute_force(spark, options):
    docs, items = some_texts(1, 150), some_texts(2, 12, longest=30)
    # Ties: copies of a text under several ids.
    docs += [(1000 + i, docs[i % 3 + 3][1]) for i in range(60)]
    assert found(spark, docs, items, **options) == brute(docs, items, options.get("k", 20))


def test_small_tiles_add_up(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "DOCS_PER_TILE", 7)
    monkeypatch.setattr(lexical_search, "TERMS_PER_TILE", 3)
    vectors = list(lexical_search.tiles([{0: 5, 1: 1}, {1: 900, 2: 3}], [10, 20, 30], 2, 5_000 * lexical_search.IMPACT))
    total = np.zeros((2, 3))
    for columns, q in vectors:
        assert len(set(columns)) == len(columns) <= 2 and q.sum(1).max() < 5_000
        np.add.at(total.T, columns, q.T)
    assert total.tolist() == [[50, 20, 0], [0, 18_000, 90]]
    docs, items = some_texts(3, 90), some_texts(4, 5, longest=30)
    assert found(spark, docs, items) == brute(docs, items)


def test_nulls_repeats_and_empties(spark, edge, clashing, empty):
    docs = [(1, "red fox"), (1, "red fox"), (None, "red fox"), (None, "red"), (2, None), (3, ""), (4, "?!"), (5, "blue " * 5000)]
    items = [(7, "red RED fox"), (7, "red RED fox"), (None, "blue"), (8, None), (9, "absent")]
    assert found(spark, docs, items) == brute(docs, items)
    plain = sorted((tuple(r) for r in lexical_search.top_documents(edge, edge, item_id_column="doc_id").collect()), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert plain == brute(rows, rows)
    assert sorted((tuple(r) for r in lexical_search.top_documents(clashing, clashing, item_id_column="doc_id").collect()), key=repr) == plain
    assert lexical_search.top_documents(empty, edge, item_id_column="doc_id").count() == 0
    none = lexical_search.top_documents(edge, empty, item_id_column="doc_id")
    assert none.count() == 0 and [f.simpleString() for f in none.schema] == ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"]


def test_many_repeats_stay_exact(spark):
    docs, items = [(i, f"rare{i} common") for i in range(40)], [(0, "rare3 " * 400_000 + "common")]
    assert found(spark, docs, items) == brute(docs, [(0, items[0][1])])
