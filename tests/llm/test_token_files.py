import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import EDGE, as_rows
from themeloom.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    found, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        found.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(found, key=repr)


def written(df, tmp_path, **options):
    folder = str(tmp_path / "tokens")
    tf.write_tokens(df, folder, PATH, **options)
    return folder


ODD = [
    (20, "it's <|endoftext|> they'll<|startoftext|>x   non breaking é ̈́ Å ﬁ 12345 ½ #$%&^"),
    (21, "y" * 300 + " " + "ab" * 40),
    (22, "\x1c\x1d\x85  İstanbul ſ K"),
]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_edges(spark, edge, clashing, tmp_path, encoding):
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string")
    whole = edge.select("doc_id", "text").union(odd)
    folder = written(whole, tmp_path, encoding=encoding)
    assert as_rows(tf.token_index(spark, folder)) == expected([r[:2] for r in EDGE] + ODD)
    other = tmp_path / "clash"
    tf.write_tokens(clashing, str(other), PATH)
    assert as_rows(tf.token_index(spark, str(other))) == expected(EDGE)


def test_given_documents_round_trip(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = written(docs.repartition(5), tmp_path, row_group_bytes=1 << 20, page_rows=20)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(tf.token_index(spark, folder)) == expected(rows)
    tokenizer = Tokenizer.from_file(PATH)
    some = tf.read_tokens(spark, folder).filter("doc_id = 500").collect()[0]
    assert list(some["ids"]) == tokenizer.encode(dict(rows)[500], add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("encoding, used", [("dictionary", "PLAIN_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")])
def test_files_have_the_layout_asked_for(spark, tmp_path, encoding, used):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = written(docs, tmp_path, encoding=encoding, row_group_bytes=100 << 10, page_rows=50)
    files = sorted((tmp_path / "tokens").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in files for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) > len(files)
    for group in groups:
        ids = group.column(2)
        assert any(used.endswith(e) or e.endswith(used) for e in ids.encodings), ids.encodings
        assert ids.has_column_index and ids.has_offset_index
    # Only what is asked for is read.
    plan = tf.read_tokens(spark, folder, ("doc_id", "n_tokens")).filter("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "EqualTo(doc_id,3)" in plan


def test_missing_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a a"), (1, "a a"), (None, "c")], "doc_id bigint, text string")
    found = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tf.token_index(spark, written(df, tmp_path)).collect())
    assert found == [(0, None, 2), (2, 1, 3), (5, 1, 3), (8, 2, 2)]


def test_an_empty_table(spark, empty, tmp_path):
    assert tf.token_index(spark, written(empty, tmp_path)).collect() == []
    with pytest.raises(ValueError, match="encoding"):
        tf.write_tokens(empty, str(tmp_path / "x"), PATH, encoding="other")


def plain(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


TEXTS = [t for _, t in ODD] + ["a b c a b", None, "", "Word. word, WORD.. Élan élan. straße ß ÿ ÷ × it's. x.y a,b <|ENDOFTEXT|> e\u0301. naïve, don't 'll. \u0301"]


def test_a_small_cache_changes_nothing(monkeypatch):
    assert tf.WordEncoder(PATH)(TEXTS) == plain(TEXTS)
    monkeypatch.setattr(tf, "CACHED_WORDS", 1)
    small = tf.WordEncoder(PATH)
    assert [small([t])[0] for t in TEXTS * 2] == plain(TEXTS) * 2


ALPHABET = "abzABZéßÿÉÞ×÷ĳſ'.,;!-0 \t\n\u00a0\u0301\u3000中<|>"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=4))
def test_any_text_is_encoded_as_by_the_tokenizer(texts):
    assert ENCODER(texts) == plain(texts)


ENCODER = tf.WordEncoder(PATH)


class Counted(dict):
    looked_up = 0

    def get(self, *a):
        self.looked_up += 1
        return super().get(*a)

    def __getitem__(self, key):
        self.looked_up += 1
        return super().__getitem__(key)


def test_each_word_of_a_batch_is_looked_up_once():
    encoder = tf.WordEncoder(PATH)
    encoder.known = Counted()
    texts = [" ".join(["some words of a text,"] * 20)] * 50
    for _ in range(2):
        assert encoder(texts) == plain(texts)
    assert encoder.known.looked_up == 2 * 5


def test_pieces_are_bounded_in_bytes_and_lose_no_row(monkeypatch):
    monkeypatch.setattr(tf, "_BATCH_BYTES", 10)
    texts = ["é" * 3, None, "", "x" * 25, "ab", "c" * 8, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    pieces = [p.column(1).to_pylist() for p in tf._pieces(iter([batch, batch.slice(3, 2), batch.slice(0, 0)]))]
    assert pieces == [texts[:3], texts[3:4], ["ab", "c" * 8], ["d"], texts[3:4], ["ab"]]
