"""Run registered queries against their SQL in DuckDB, order-insensitively.

    python -m tests.compare [name ...]     names, or prefixes ending in *
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


TIMES: list[float] = []


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else repr(float(v))  # tells -0.0 from 0.0
    if isinstance(v, np.generic):
        return v.item()
    return v


def _sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences in names, types, row count or values."""
    clock = [time.time()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    expected_rows = result.fetchall()
    clock.append(time.time())
    out = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    order = sorted(names)
    for name, kind in df.dtypes:
        if TYPES.get(kind, kind) != types[name]:
            out.append(f"type of {name}: {kind} vs {types[name]}")
    pos = [names.index(c) for c in order]
    expected = sorted((tuple(_plain(r[i]) for i in pos) for r in expected_rows), key=_sort_key)
    collected = df.select(*order).collect()
    clock.append(time.time())
    TIMES[:] = [clock[1] - clock[0], clock[2] - clock[1], len(expected)]
    actual = sorted((tuple(_plain(v) for v in r) for r in collected), key=_sort_key)
    if len(actual) != len(expected):
        out.append(f"rows {len(actual)} vs {len(expected)}")
    if actual != expected:
        missing = [r for r in zip(actual, expected) if r[0] != r[1]][:3]
        out.append(f"values differ, columns {order}: {missing}")
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tidewatch.session import build_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", 8)
    con = database(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sqls:
                found = differences(df, con, sqls[name])
                rows = "sql %.1fs, spark %.1fs, %d rows" % tuple(TIMES)
            else:
                rows, found = f"rows only: {len(df.collect())}", []
        except Exception as error:  # noqa: BLE001
            rows, found = "", [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name:32s} {time.time() - start:6.2f}s {rows}", flush=True)
        for line in found:
            print("      ", line[:2500], flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
