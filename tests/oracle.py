"""Run registered queries next to their SQL and compare: ``python tests/oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(None if pd.isna(x) else (float(x) if isinstance(x, float) else x) for x in r) for r in pdf[cols].itertuples(index=False)]
    return cols, sorted(rows, key=repr)


def compare(spark_pdf, duck_pdf, tolerance: float = 0.0) -> str:
    (c1, r1), (c2, r2) = canonical(spark_pdf), canonical(duck_pdf)
    if c1 != c2:
        return f"columns differ: {c1} | {c2}"
    if len(r1) != len(r2):
        return f"rows differ: {len(r1)} | {len(r2)}"
    kinds1 = [spark_pdf[c].dtype.kind for c in c1]
    kinds2 = [duck_pdf[c].dtype.kind for c in c2]
    if kinds1 != kinds2:
        return f"types differ: {list(zip(c1, kinds1, kinds2))}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    return "" if not bad else f"{len(bad)} of {len(r1)} values differ, first: {c1} {bad[0]}"


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries as registered
    from telespan.scratch import release

    sf, names = sys.argv[1], sys.argv[2:]
    queries, sql = registered(), oracle_sql()
    names = [n for n in queries if not names or any(n.startswith(p) for p in names)]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, sf).toPandas()
            spent = time.time() - start
            if name in sql:
                start = time.time()
                want = con.execute(sql[name]).df()
                problem = compare(got, want)
                note = f"duckdb {time.time() - start:.2f}s"
            else:
                problem, note = "", "rows only"
        except Exception as exc:
            got, problem, note, spent = [], f"{type(exc).__name__}: {str(exc)[:900]}", "", time.time() - start
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok':4} {name:36} rows={len(got):7} spark {spent:.2f}s {note} {problem}", flush=True)
    release(spark)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
