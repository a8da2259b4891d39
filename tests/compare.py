"""Run registered queries and their SQL side by side: python tests/compare.py [sf_dir] [name prefix …]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()  # fmt: skip


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when rows, values and column names agree."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    expected = con.sql(sql)
    want = _rows(expected.columns, expected.fetchall())
    if sorted(df.columns) != sorted(expected.columns):
        return f"columns {sorted(df.columns)} != {sorted(expected.columns)}"
    if got == want:
        return None
    only_got, only_want = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows, expected {len(want)}; only here {only_got}; only there {only_want}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from wortlaut.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = tuple(sys.argv[2:]) or ("",)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if not name.startswith(prefixes):
            continue
        began = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, name, query, oracles[name], sf_dir)
                rows = con.sql(f"SELECT count(*) FROM ({oracles[name]})").fetchall()[0][0]
            else:
                rows, problem = query(spark, sf_dir).count(), None
        except Exception as e:  # show every query's state
            rows, problem = 0, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28} {rows:8} rows {time.time() - began:6.2f}s "
              f"{'' if name in oracles else '(no SQL)'} {problem or ''}", flush=True)  # fmt: skip
    print("failed:", failed)
