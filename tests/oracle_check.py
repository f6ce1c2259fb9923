"""Compare registered queries with their DuckDB oracle: ``oracle_check.py SF [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> list[str]:
    got_cols = df.columns
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    want_cols = [d[0] for d in res.description]
    want = res.fetchall()
    problems = []
    if sorted(got_cols) != sorted(want_cols):
        return [f"columns {sorted(got_cols)} vs {sorted(want_cols)}"]
    types = {d[0]: str(d[1]) for d in res.description}
    family = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN",
    }
    for c, t in df.dtypes:
        if family.get(t, t) != types[c]:
            problems.append(f"type of {c}: {t} vs {types[c]}")
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        problems.append(f"{len(diff)} differing rows, first {diff[0]}")
    if not a:
        problems.append("empty result")
    return problems


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    from cohortforge.catalogue import catalogue

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = sys.argv[2:]
    for name, (fn, sql) in catalogue().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                n = df.count()
                verdict = f"rows-only {n}"
            else:
                problems = compare(df, con, sql)
                verdict = "ok" if not problems else "; ".join(problems)
        except Exception as exc:  # noqa: BLE001
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {verdict}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
