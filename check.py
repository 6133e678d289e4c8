"""Run registered queries beside their SQL and report differences.

    python check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT",
}


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple(str(v) for v in r))


def compare(spark, con, entry, folder: str) -> tuple[str, int, float]:
    start = time.time()
    df = entry.run(spark, folder)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    took = time.time() - start
    if entry.sql is None:
        return "rows only", len(got), took
    cur = con.execute(entry.sql)
    want_names = [c[0] for c in cur.description]
    want_types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} vs {sorted(want_names)}", len(got), took
    a, b = _rows(got_names, got), _rows(want_names, want)
    note = ""
    for name, kind in df.dtypes:
        if TYPES.get(kind) != want_types[name]:
            note += f" [type {name}: {kind} vs {want_types[name]}]"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}{note}", len(got), took
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {sorted(got_names)}\n   {bad[0][0]}\n   {bad[0][1]}{note}", len(got), took
    return "equal" + note, len(got), took


def main() -> int:
    from catalog import REGISTRY
    from tidemark.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con = local_session("check"), oracle(args.sf)
    failed = 0
    for name in args.names or REGISTRY:
        try:
            result, n, took = compare(spark, con, REGISTRY[name], args.sf)
        except Exception as exc:  # noqa: BLE001 - report and go on
            result, n, took = f"error {type(exc).__name__}: {str(exc)[:900]}", 0, 0.0
        ok = result in ("equal", "rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name:24s} {n:7d} rows {took:6.2f}s  {result}", flush=True)
    print(f"{failed} bad")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
