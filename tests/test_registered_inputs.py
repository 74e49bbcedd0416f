"""The files that queries write as inputs grow in number, not in size."""

from glob import glob

import pytest

from checks import queries
from themeloom.functions.storage import stage_folder


@pytest.fixture
def documents(spark, tmp_path):
    """A folder of tables whose documents lie in six files, each read by a task of its own."""
    rows = [(i, None if i == 7 else f'text "{i % 50}", of some\nlength äöü', ["en", "fr", "de"][i % 3], f"src{i % 7}", 30 + i % 50) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "3000")
    yield str(tmp_path), rows
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def new_files(spark, name, before=()):
    return set(glob(f"{stage_folder(spark).removeprefix('file:')}/{name}")) - set(before)


def test_streamed_rows_are_not_put_into_one_file(spark, documents):
    folder, rows = documents
    before = new_files(spark, "stream-*/in/part-*.parquet")
    found = queries.streamed_first_copies(spark, folder).collect()
    first = {}
    for i, text, _, source, _ in rows:
        if source not in ("src3", "src4") and text is not None:
            first.setdefault(text, i)
    assert sorted(r["row_id"] for r in found) == sorted(first.values())
    # Two micro-batches from six tasks each, and the closing row.
    assert len(new_files(spark, "stream-*/in/part-*.parquet", before)) >= 9


@pytest.mark.parametrize("query", ["csv_files", "tsv_files"])
def test_delimited_files_get_more_with_more_text(spark, documents, monkeypatch, query):
    folder, rows = documents
    before = new_files(spark, "files-*/*/part-*.csv")
    few = sorted(map(tuple, getattr(queries, query)(spark, folder).collect()))
    some = new_files(spark, "files-*/*/part-*.csv", before)
    monkeypatch.setattr(queries, "_FILE_BYTES", 1000)
    many = sorted(map(tuple, getattr(queries, query)(spark, folder).collect()))
    assert few == many and [r[0] for r in many] == [r[0] for r in rows]
    assert len(some) <= 8 and len(new_files(spark, "files-*/*/part-*.csv", before) - some) >= 14
