"""The stages against the operators' rules stated in Python, and the entry with and without the folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from tests.llm.conftest import EDGE, squeezed, words
from tests.llm.test_decontamination import brute
from tests.llm.test_simhash_dedup import brute_components, brute_fingerprint

REPO = Path(__file__).resolve().parents[2]


def expected(rows, bench):
    """Ids left after languages, copies, near copies and benchmark passages."""
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    first = {}
    for i, t in sorted(rows):
        first.setdefault(squeezed(t), i)
    rows = [(i, t) for i, t in rows if first[squeezed(t)] == i]
    component = brute_components({i: brute_fingerprint(t) for i, t in rows})
    rows = [(i, t) for i, t in rows if component[i] == i]
    leaked = {i for i, _ in brute(rows, bench)}
    return [(i, t) for i, t in rows if i not in leaked]


def folder_of(spark, tmp_path, docs, bench):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_keep_what_they_should(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(words(t)) for i, t in expected(rows, bench)}
    assert len(found) > 100


def test_edges_and_columns(spark, tmp_path, clashing):
    """Nulls, empty and very long texts, repeats and clashing columns, through all stages but the last unchanged."""
    docs = clashing
    bench = spark.createDataFrame([(1, "Der schnelle braune Fuchs springt über den faulen Hund")], "item_id bigint, text string")
    folder = folder_of(spark, tmp_path, docs, bench)
    kept = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = function(spark, kept, folder)
        assert sorted(kept.columns) == sorted(docs.columns), name
    wanted = {i for i, _ in expected([r[:2] for r in EDGE], [(1, bench.head()["text"])])}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == wanted


def test_an_empty_table(spark, tmp_path, empty):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id bigint, text string")
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path, empty, bench)).collect() == []


def test_the_entry_works_without_the_folder(tmp_path):
    for name in ("__spark_entry__.py", "checks", "themeloom"):
        source = REPO / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm")} if source.is_dir() else {}))
    code = "import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr
