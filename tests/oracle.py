"""Run a registered query and its SQL over the same tables and compare the rows as unordered bags."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def close(left: Counter, right: Counter, tolerance: float = 1e-7) -> bool:
    """Whether the rows that differ pair off within a relative tolerance of their doubles."""
    def order(row):
        return [(type(v).__name__, str(v)) for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)]

    x, y = sorted(left.elements(), key=order), sorted(right.elements(), key=order)
    if len(x) != len(y):
        return False
    same = lambda v, w: v == w or isinstance(v, (int, float)) and isinstance(w, (int, float)) and math.isclose(v, w, rel_tol=tolerance, abs_tol=tolerance)
    return all(all(map(same, v, w)) for v, w in zip(x, y))


def compare(spark, con, entry, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.run(spark, sf)
    got = df.collect()
    took = time.time() - start
    if entry.sql is None:
        return True, f"{took:6.2f}s rows={len(got)} (no SQL)"
    result = con.execute(entry.sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = bag(df.columns, got), bag(names, want)
    if a == b:
        return True, f"{took:6.2f}s rows={len(got)}"
    if close(a - b, b - a):
        return True, f"{took:6.2f}s rows={len(got)} (by tolerance)"
    extra, missing = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, f"{took:6.2f}s rows={len(got)}/{len(want)} differ={sum((a - b).values())}\n  got  {str(extra)[:900]}\n  want {str(missing)[:900]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry_module
    from mergescope.session import build_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = build_session()
    con = connect(sf)
    wanted = sys.argv[1:]
    failed = []
    for name, entry in entry_module.entries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, entry, sf)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not ok:
            failed.append(name)
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", failed)
