import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import EDGE, as_rows
from themeloom.llm import language_id as li


def docs_of(spark, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")


def test_held_out_documents_are_told_apart(spark):
    docs = docs_of(spark)
    found = li.identify(docs).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    held = found.filter("held_out and n > 100")
    right = held.filter("lang_pred = lang").count() / held.count()
    assert right > 0.98
    assert found.filter("score < 0 or score > 1").count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found.collect())


def test_edges(edge, clashing, empty):
    found = {r["doc_id"]: r for r in li.identify(edge).collect()}
    assert len(found) == len(EDGE)
    for i in (2, 3, 4, 7):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    learned = {lang for i, t, lang in EDGE if t and lang and zlib.crc32(str(i).encode()) % 5}
    assert {found[i]["lang_pred"] for i in found} <= learned | {"und"}
    assert found[8]["lang_pred"] == found[9]["lang_pred"]
    assert as_rows(li.identify(clashing)) == as_rows(li.identify(edge))
    assert li.identify(empty).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (None, "other text", "en")], "doc_id bigint, text string, lang string")
    assert as_rows(li.identify(df), "lang_pred", "score") == [("und", 0.0), ("und", 0.0)]
    assert as_rows(li.identify(df), "doc_id", "held_out") == sorted([(1, False), (None, True)], key=repr)


def test_prediction_ignores_the_label(spark):
    docs = docs_of(spark, "0.001")
    shuffled = docs.withColumn("lang", F.when(li.in_training(F.col("doc_id")), F.col("lang")).otherwise("zz"))
    assert as_rows(li.identify(docs)) == as_rows(li.identify(shuffled))


def test_texts_without_letters_go(edge):
    kept = li.keep_known(edge)
    assert kept.columns == edge.columns
    assert as_rows(kept, "doc_id") == sorted(((i,) for i, *_ in EDGE if i not in (2, 3, 4, 7)), key=repr)


def test_pieces_of_a_long_text_lose_no_ngram(monkeypatch):
    text = "Äbc d3f \U0001f600 gh" * 50
    whole = li.ngram_counts(text)
    monkeypatch.setattr(li, "_PIECE", 7)
    parts = li.ngram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert whole[1].sum() == sum(len(text) - n + 1 for n in (1, 2, 3))


def test_training_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    vectors, labels = [], []
    for _ in range(300):
        k = int(rng.integers(3))
        used = np.unique(np.append(rng.integers(30, 100, 5), [k * 2, k * 2 + 1]))
        vectors.append((used, np.ones(len(used)) / np.sqrt(len(used))))
        labels.append(k)
    w = li.ftrl(vectors, np.array(labels), 3, 200, l1=0.5)
    right = np.mean([(v @ w[u]).argmax() == k for (u, v), k in zip(vectors, labels)])
    assert right > 0.97 and (w[100:] == 0).all() and (w[30:100] == 0).mean() > 0.3


def test_temperature_undoes_a_scale():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=row) for row in p])
    assert 4 < li.temperature(logits * 5, labels) < 6.3


def test_a_rare_language_is_learned(spark):
    """Four documents among 20,000, none of which the sample by hash need hold."""
    english = "the quick brown fox jumps over the lazy dog and runs home"
    russian = ["\u0431\u044b\u0441\u0442\u0440\u0430\u044f \u043b\u0438\u0441\u0430", "\u043b\u0435\u043d\u0438\u0432\u0430\u044f \u0441\u043e\u0431\u0430\u043a\u0430", "\u0431\u044b\u0441\u0442\u0440\u0430\u044f \u0441\u043e\u0431\u0430\u043a\u0430"]
    df = spark.range(20_000).selectExpr("id as doc_id", f"concat('{english} ', id) as text", "'en' as lang")
    train = [i for i in range(20_000, 20_100) if zlib.crc32(str(i).encode()) % 5][:4]
    rare = spark.createDataFrame([(i, russian[k % 2], "ru") for k, i in enumerate(train)] + [(30_000, russian[2], None)], "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in li.identify(df.unionByName(rare), fit_rows=300, calibrate_rows=100).filter("doc_id >= 19990").collect()}
    assert all(found[i] == "ru" for i in [*train, 30_000]) and found[19_995] == "en"


def test_without_labels_only_texts_without_a_letter_go(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "123 !", None), (3, None, None), (None, "caf\u00e9", None)], "doc_id bigint, text string, lang string")
    assert sorted(r["text"] for r in li.keep_known(df).collect()) == ["caf\u00e9", "some text"]
    assert {r["lang_pred"] for r in li.identify(df).collect()} == {"und"}


def test_a_language_that_only_calibrates_is_learned_too(spark):
    rows = [(i, "plain english words here", "en") for i in range(50)] + [(i, "\u03b1\u03b2\u03b3\u03b4 \u03b5\u03b6", "el") for i in range(50, 62)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in li.identify(df, fit_rows=2, calibrate_rows=60).collect()}
    assert found[0] == "en" and found[61] == "el"
