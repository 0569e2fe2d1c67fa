"""Runs registered queries on Spark and their oracles on DuckDB and compares the rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks import oracles, queries
from runledger.session import build

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark: SparkSession, oracle: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty when both agree, else what differs."""
    found = queries.registry()[name](spark, sf_dir)
    left = _rows(found.columns, [tuple(row) for row in found.collect()])
    sql = oracles.registry().get(name)
    if sql is None:
        return "no oracle"
    answer = oracle.execute(sql)
    columns = [column[0] for column in answer.description]
    right = _rows(columns, answer.fetchall())
    if sorted(columns) != sorted(found.columns):
        return f"columns differ: {sorted(set(columns) ^ set(found.columns))}"
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}" if wrong else ""


def main(sf_dir: str, names: list[str]) -> None:
    spark = build("local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    oracle = oracle_connection(sf_dir)
    failed = 0
    for name in names or list(queries.registry()):
        started = time.time()
        try:
            verdict = compare(spark, oracle, sf_dir, name)
        except Exception as problem:
            verdict = f"{type(problem).__name__}: {str(problem)[:1500]}"
        failed += bool(verdict)
        print(f"{name:32s} {time.time() - started:6.2f}s  {verdict or 'ok'}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments.pop(0) if arguments and os.path.isdir(arguments[0]) else "/root/testdata/sf0.001"
    main(folder, arguments)
