"""Run queries and their SQL twins side by side on one folder of tables.

    python tests/compare.py /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


TIMES: dict[str, float] = {}


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _rows(table) -> tuple[list[str], list[str]]:
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    return names, sorted(map(str, zip(*columns, strict=True))) if columns else []


def compare(spark: SparkSession, connection, folder: str, name: str, fn, sql: str | None) -> str | None:
    """None when equal, else what differs."""
    began = time.time()
    got_names, got = _rows(fn(spark, folder).toArrow())
    TIMES[name] = time.time() - began
    if sql is None:
        return None if got else "no rows"
    want_names, want = _rows(connection.execute(sql).to_arrow_table())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        only_got, only_want = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} vs {len(want)}; only here {only_got}; only in SQL {only_want}"
    return None if got else "equal but empty"


def session(cpus: int = 8, partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def main(folder: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    connection, twins, bad = database(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        began = time.time()
        try:
            problem = compare(spark, connection, folder, name, fn, twins.get(name))
        except Exception as error:  # noqa: BLE001  (report and go on)
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {TIMES.get(name, 0):6.2f}s + sql {time.time() - began - TIMES.get(name, 0):6.2f}s {name} {problem or ''}", flush=True)
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
