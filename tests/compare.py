"""Run registered queries next to their SQL in DuckDB and compare names, types and values."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
              "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cols = []
    for c in frame.columns:
        cols.append([None if pd.isna(v) else (float(v) if isinstance(v, float) else
                     str(v)[:10] if hasattr(v, "year") else v) for v in frame[c].astype(object)])
    return sorted(zip(*cols), key=repr) if cols else []


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    return type(a) is type(b) and a == b or (a == b and not isinstance(a, bool) and not isinstance(b, bool))


def compare(spark, sf_dir: str, fn, sql: str, con) -> str | None:
    """None when equal, else what differs."""
    from cohortline.session import scratch

    with scratch(spark):
        df = fn(spark, sf_dir)
        got = df.toPandas()
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, map(str, rel.types)))
    want = rel.df()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = [(c, t, want_types[c]) for c, t in df.dtypes if TYPE_NAMES.get(t, t) != want_types[c]]
    if types:
        return f"types {types}"
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if not all(_same(p, q) for p, q in zip(x, y))]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[:2]} {sorted(df.columns)}" if bad else None


def main() -> None:
    import os

    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cohortline.session import scratch

    sf_dir = sys.argv[1]
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in oracle:
                message = compare(spark, sf_dir, fn, oracle[name], con) or "ok"
            else:
                with scratch(spark):
                    rows = fn(spark, sf_dir).collect()
                message = f"rows-only {len(rows)} {rows[:3] if names else ''}"
        except Exception as ex:  # report and go on with the next query
            message = f"ERROR {type(ex).__name__} {str(ex)[:700]}"
        bad += not (message == "ok" or message.startswith("rows-only"))
        print(f"{name:32s} {time.time() - start:6.2f}s {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
