import pytest
from pyspark.sql import functions as F

from themeloom.sources import files, sinks


def write(path, name, data, encoding="utf-8"):
    (path / name).write_bytes(data.encode(encoding))
    return str(path / name)


def test_missing_value_tokens_become_null(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'id,text\n1,None\n2,N/A\n3,null\n4,"kept, with comma"\n5,\n6,"two\nlines ""quoted"""\n7,nope\n')
    rows = files.read_answers(spark, path, "text").orderBy("row_id").collect()
    assert [r["text"] for r in rows] == [None, None, None, "kept, with comma", None, 'two\nlines "quoted"', "nope"]
    assert [r["id"] for r in rows] == [1, 2, 3, 4, 5, 6, 7]
    kept = files.read_delimited(spark, path, text="text", na_tokens=None).filter("id = 1").first()
    assert kept["text"] == "None"


def test_encodings_are_found_per_file(spark, tmp_path):
    a = write(tmp_path, "a.csv", "id,text\n1,café un\n")
    b = write(tmp_path, "b.csv", "id,text\n2,café deux\n", "latin-1")
    rows = files.read_delimited(spark, [a, b], text="text").orderBy("row_id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [(1, "café un"), (2, "café deux")]


def test_tsv(spark, tmp_path):
    path = write(tmp_path, "a.tsv", "id\ttext\n1\ta, b\n2\tNA\n")
    rows = files.read_delimited(spark, path).orderBy("row_id").collect()
    assert [(r["id"], r["text"]) for r in rows] == [(1, "a, b"), (2, None)]


def test_row_ids_follow_file_order_across_splits(spark, tmp_path):
    body = "".join(f"{i},text number {i}\n" for i in range(3000))
    path = write(tmp_path, "a.csv", "id,text\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = files.read_delimited(spark, path, schema="id bigint, text string", multi_line=False)
        rows = df.orderBy("row_id").collect()
        assert df.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["id"] for r in rows] == list(range(3000))
    assert len({r["row_id"] for r in rows}) == 3000


def test_validation(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,text\n1,x\n")
    assert files.validate_input(spark, path, ["text"]) == (True, "ok")
    ok, message = files.validate_input(spark, path, ["text", "answer"])
    assert not ok and message == "no column answer among id, text"
    assert files.validate_input(spark, str(tmp_path / "none.csv"), ["text"])[1].startswith("there is no ")
    assert files.validate_input(spark, str(tmp_path / "a.docx"), ["text"])[1].startswith("files ending in .docx are not read")
    with pytest.raises(ValueError, match="no column answer"):
        files.read_answers(spark, path, "answer")


def test_rows_and_ids_outlive_another_split(spark, tmp_path):
    path = write(tmp_path, "many.csv", "id,text\n" + "".join(f"{i},text number {i}\n" for i in range(3000)))
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        df = files.read_delimited(spark, path, schema="id bigint, text string", multi_line=False)
        before = {r["id"]: r["row_id"] for r in df.collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "11k")
        after = {r["id"]: r["row_id"] for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert before == after and len(before) == 3000
    assert sorted(before, key=before.get) == list(range(3000))


def test_a_named_encoding_is_used(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("id,text\n1,café 日本語\n".encode("utf-16"))
    assert files.read_delimited(spark, str(tmp_path / "w.csv"), encoding="UTF-16").first()["text"] == "café 日本語"


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", é\nb', ["x", "y"])], "id int, text string, themes array<string>")
    out = str(tmp_path / "out")
    sinks.write_table(df, out, "csv")
    row = spark.read.csv(out, header=True, multiLine=True, escape='"').first()
    assert (row["id"], row["text"], row["themes"]) == ("1", 'a "q", é\nb', "x, y")
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "o2"), "xlsx")


def test_json_documents(spark, tmp_path):
    df = spark.createDataFrame([("s", '{"a":1}'), ("t", '{"b":2}')], "section string, json string")
    sinks.write_json_documents(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "section=t")).first()["b"] == 2


def test_parquet_sink(spark, tmp_path):
    sinks.write_table(spark.range(3).withColumn("m", F.array("id")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_thousands_of_files_in_either_encoding(spark, tmp_path, monkeypatch):
    """One scan of the files, of which the driver gets no list."""
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(5000):
        (folder / f"{i:04}.csv").write_bytes(f"id,text\n{i},café {i}\n{i + 5000},plain {i}\n".encode("latin-1" if i % 7 == 3 else "utf-8"))
    staged, most = [], 0
    stage, collect = files.stage, type(spark.range(1)).collect

    def watched(df):
        nonlocal most
        rows = collect(df)
        most = max(most, len(rows))
        return rows

    monkeypatch.setattr(files, "stage", lambda df: staged.append(df) or stage(df))
    monkeypatch.setattr(type(spark.range(1)), "collect", watched)
    df = files.read_delimited(spark, str(folder), schema="id bigint, text string", text="text")
    assert most <= 1
    monkeypatch.undo()
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (*staged, df)]
    assert sum(p.count("FileScan csv") for p in plans) == 1
    assert {(r["id"], r["text"]) for r in df.collect()} == {(i, f"café {i}") for i in range(5000)} | {(i + 5000, f"plain {i}") for i in range(5000)}


def test_types_come_from_the_cells(spark, tmp_path):
    body = "a,b,c,d,e,f,text\n1,1.5,true,2024-01-31,x,,7\nNA,2,false,2024-02-01 10:00:00,3,NA,8\n99999999999,-1e3,TRUE,,NaN,,None\n"
    df = files.read_delimited(spark, write(tmp_path, "a.csv", body), text="text")
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "bigint", "double", "boolean", "timestamp", "string", "string", "string"]
    rows = df.orderBy("row_id").collect()
    assert [r["a"] for r in rows] == [1, None, 99999999999] and [r["text"] for r in rows] == ["7", "8", None]
    assert [r["e"] for r in rows] == ["x", "3", "NaN"] and df.columns == ["row_id", "a", "b", "c", "d", "e", "f", "text"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_names_are_decoded_too(spark, tmp_path, encoding):
    path = write(tmp_path, "a.csv", "réponse,id\nété,1\nN/A,2\n", encoding)
    rows = files.read_answers(spark, path, "réponse").orderBy("row_id").collect()
    assert [(r["réponse"], r["id"]) for r in rows] == [("été", 1), (None, 2)]


def test_files_without_rows(spark, tmp_path):
    assert files.read_delimited(spark, write(tmp_path, "a.csv", "id,text\n"), schema="id int, text string").count() == 0
    assert files.read_delimited(spark, write(tmp_path, "b.csv", "id,text\n")).columns == ["row_id", "id", "text"]
