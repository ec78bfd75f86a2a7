"""Compare registered queries with their SQL.  Run as a script for a report:

    python tests/oracle.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def as_rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(spark, con, query, sql: str, folder: str) -> list[str]:
    df = query(spark, folder)
    got = as_rows(df.columns, [tuple(row) for row in df.collect()])
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = as_rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    extra, missing = got - want, want - got
    found = []
    if extra or missing:
        found.append(f"{sum(extra.values())} extra, {sum(missing.values())} missing of {sum(want.values())}")
        found += [f"  extra   {row}" for row in list(extra)[:3]]
        found += [f"  missing {row}" for row in list(missing)[:3]]
    if not want:
        found.append("empty result")
    return found


def main() -> None:
    import __spark_entry__ as entry
    from eventtally.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8",
                          spark__sql__session__timeZone="America/New_York")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            found = differences(spark, con, query, sql[name], folder) if name in sql else ["no SQL"]
        except Exception as error:  # report and go on
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{name:26s} {time.time() - start:6.1f}s {'ok' if not found else ''}", flush=True)
        for line in found:
            print("   ", line)
    print("failed:", bad)


if __name__ == "__main__":
    main()
