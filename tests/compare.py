"""Spark result against the DuckDB result of the same query, row by row."""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs; empty when both have the same columns and the same bag of rows."""
    relation = con.sql(sql)
    names = sorted(relation.columns)
    if sorted(spark_df.columns) != names:
        return [f"columns {sorted(spark_df.columns)} instead of {names}"]
    order = [relation.columns.index(n) for n in names]
    expected = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    found = Counter(tuple(row) for row in spark_df.select(*names).collect())
    out = []
    for label, rows in (("missing", expected - found), ("unexpected", found - expected)):
        if rows:
            out.append(f"{label} {sum(rows.values())}: {list(rows)[:2]!r:.1500}")
    return out


def run(spark, folder: str, only: list[str]) -> int:
    import __spark_entry__ as entry

    con, sql, bad = tables(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            diff = differences(query(spark, folder), con, sql[name])
        except Exception as error:  # noqa: BLE001 - shown as a failed query
            diff = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'ok':4} {name} {time.time() - start:.1f}s", *diff, sep="\n     " if diff else " ", flush=True)
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(run(session, sys.argv[1], sys.argv[2:]))
