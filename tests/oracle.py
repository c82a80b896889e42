"""Compare a query with its SQL in DuckDB: columns sorted by name, rows as a multiset."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    left = Counter(tuple(map(_value, r)) for r in df.select(*names).collect())
    out = con.sql(sql)
    if names != sorted(out.columns):
        return f"columns {names} and {sorted(out.columns)}"
    order = [out.columns.index(n) for n in names]
    right = Counter(tuple(_value(r[i]) for i in order) for r in out.fetchall())
    if left == right:
        return "" if left else "no rows"
    return f"{sum(left.values())} and {sum(right.values())} rows; only in Spark: {list((left - right).items())[:3]}; only in SQL: {list((right - left).items())[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e

    from tessera.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    all_q, all_s = e.queries(), e.oracle_sql()
    for name in [n for n in all_q if not names or any(n.startswith(x) for x in names)]:
        began = time.time()
        try:
            said = differences(spark, con, all_q[name], all_s[name], sf_dir) if name in all_s else f"no SQL; {all_q[name](spark, sf_dir).count()} rows"
        except Exception as error:
            said = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
