"""The registered queries as a driver calls them."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import oracle_rows, spark_rows

REPO = Path(__file__).resolve().parents[2]
NAMES = [n for n in entry.queries() if n.startswith("op")]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_queries_agree_with_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(entry.queries()[name](spark, folder)) == oracle_rows(folder, entry.oracle_sql()[name])


def test_workers_need_no_path_of_ours(tmp_path):
    """A session started elsewhere, without our folder on its workers' path."""
    code = (
        "from pyspark.sql import SparkSession; import sys\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"sys.path.insert(0, {str(REPO)!r})\n"
        "import __spark_entry__ as e\n"
        "print(e.queries()['op8_language_id'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and out.stdout.split()[-1] == "200", out.stderr[-2000:]
