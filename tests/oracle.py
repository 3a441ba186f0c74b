"""Compare named queries with their SQL, row by row and order-insensitive."""

from __future__ import annotations

import datetime
import decimal
import math
import sys

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_value(row[i]) for i in order) for row in data]
    return [columns[i] for i in order], sorted(shaped, key=repr)


def compare(frame, con, sql: str) -> tuple[bool, str]:
    left = rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    right = rows([d[0] for d in result.description], result.fetchall())
    if left == right:
        return True, f"{len(left[1])} rows"
    if left[0] != right[0]:
        return False, f"columns {left[0]} / {right[0]}"
    diff = [(a, b) for a, b in zip(left[1], right[1]) if a != b][:2]
    return False, f"rows {len(left[1])} / {len(right[1])}, first differences {str(diff)[:700]}"


def main(folder: str, names: list[str]) -> None:
    import time

    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from shelfmark.session import build_session

    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    sqls = entry.oracle_sql()
    for name, function in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, note = compare(function(spark, folder), con, sqls[name])
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
