"""Run queries beside their SQL and report differences.

    python -m checks.compare [--sf DIR] [--time] [query ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def session(cores: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("themeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), _rows(columns, found.fetchall())


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def difference(name: str, spark: SparkSession, sf_dir: str) -> str | None:
    """None if both agree, else what differs first."""
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    expected_columns, expected = oracle_rows(sf_dir, ORACLES[name])
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}; ours only {[r for r in rows if r not in expected][:2]}, theirs only {[r for r in expected if r not in rows][:2]}"
    for mine, theirs in zip(rows, expected):
        if repr(mine) != repr(theirs):
            return f"{mine} != {theirs}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = session()
    wrong = 0
    for name in args.names or QUERIES:
        started = time.time()
        try:
            problem = difference(name, spark, args.sf) if name in ORACLES else "no oracle"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        wrong += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - started:.1f}s {problem or ''}"[:1500], flush=True)
    print(f"{wrong} differences")
    return 1 if wrong else 0


if __name__ == "__main__":
    sys.exit(main())
