"""Run registered queries on both engines and compare the rows.

    python tests/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from reviewlens.catalog.views import TABLES  # noqa: E402

DEFAULT = "/root/testdata/sf0.01"


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return "NaN" if math.isnan(x) else repr(x + 0.0)
        return repr(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql):
    """Empty text when both agree, else what differs."""
    result = con.execute(sql)
    oracle_columns = [d[0] for d in result.description]
    oracle_rows = result.fetchall()
    rows = [tuple(r) for r in spark_df.collect()]
    if sorted(spark_df.columns) != sorted(oracle_columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(oracle_columns)}"
    a, b = canonical(rows, spark_df.columns), canonical(oracle_rows, oracle_columns)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} vs {len(b)} rows; spark {str(only_a[:2])[:500]} | oracle {str(only_b[:2])[:500]}"


def main(argv):
    from conftest import make_spark
    import __spark_entry__ as entry

    folder = DEFAULT
    if "--sf" in argv:
        i = argv.index("--sf")
        folder = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark, con = make_spark(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in argv or list(queries):
        start = time.time()
        try:
            df = queries[name](spark, folder)
            message = compare(df, con, oracles[name]) if name in oracles else f"rows {df.count()}"
        except Exception as error:
            message = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        ok = message == "" or message.startswith("rows ")
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'BAD '} {name:24s} {time.time() - start:6.1f}s {message}", flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])
