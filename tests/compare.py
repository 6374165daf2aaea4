"""Run registered queries against their oracle SQL: python tests/compare.py SF_DIR [name …]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v)):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return round(v, 6)
        return v

    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(oracle_df.columns)}"
    a, b = canonical(spark_df), canonical(oracle_df)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}; only spark {list(set(a) - set(b))[:3]}; only oracle {list(set(b) - set(a))[:3]}"
    for x, y in zip(a, b):
        if any(
            (u is None) != (v is None) or (str(u) != str(v) and u != v) for u, v in zip(x, y)
        ):
            return f"{str(x)[:600]} / {str(y)[:600]}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    from feedwatch.plans import registry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    sql = registry.oracle_sql()
    for name, run in registry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            if name not in sql:
                print(f"ROWS {name:22s} spark {took:6.2f}s rows {len(got)}", flush=True)
                continue
            want = con.execute(sql[name]).fetchdf()
            diff = difference(got, want)
        except Exception as e:  # report and go on
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
            continue
        oracle_time = time.time() - start
        state = "OK  " if diff is None else "DIFF"
        print(f"{state} {name:22s} spark {took:6.2f}s oracle {oracle_time:6.2f}s rows {len(got)} {diff or ''}", flush=True)


if __name__ == "__main__":
    main()
