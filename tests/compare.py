"""Run registered queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=pdf.index)
    for c in sorted(pdf.columns):
        s = pdf[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            s = s.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(s) or (s.dtype == object and s.map(lambda v: isinstance(v, (bool, np.bool_))).any()):
            s = s.map(str)
        elif pd.api.types.is_numeric_dtype(s):
            s = s.astype(float)
        else:
            s = s.map(lambda v: "NULL" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        out[c] = s
    return out.sort_values(list(out.columns), ignore_index=True)


def compare(spark_df, con, sql: str) -> str:
    """Empty text when equal, else what differs."""
    ours, theirs = canonical(spark_df.toPandas()), canonical(con.execute(sql).df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} vs {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    if not len(ours):
        return "no rows"
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        bad = ~((a == b) | (a.isna() & b.isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values differ in {c}, first: {a[i]!r} vs {b[i]!r}"
    return ""


def main(sf: str, keys: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

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
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles, failed = entry.queries(), entry.oracle_sql(), 0
    for key in keys or queries:
        t = time.time()
        try:
            if key in oracles:
                diff = compare(queries[key](spark, sf_dir), con, oracles[key])
                note = diff or "equal"
            else:
                rows = len(queries[key](spark, sf_dir).toPandas())
                diff, note = ("" if rows else "no rows"), f"{rows} rows"
        except Exception as e:  # report and go on with the next query
            diff = note = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {key:28s} {time.time() - t:6.2f}s  {note}", flush=True)
    print(f"{failed} failed of {len(keys or queries)}")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
