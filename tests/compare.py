"""Run registered queries in Spark and DuckDB and compare rows exactly.

``python -m tests.compare [folder] [key ...]``
"""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, query, sql, folder) -> str | None:
    """None when names, types and all values agree, else what differs."""
    df = query(spark, folder)
    got_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    want_types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    if got_types != want_types:
        return f"types {sorted(set(got_types.items()) ^ set(want_types.items()))}"
    names = list(want_types)
    want = _rows(names, con.execute(sql).fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows, e.g. {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from revlens.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(entry.queries())
    spark, con, failed = local_session(8), connect(folder), 0
    for key in keys:
        began = time.time()
        try:
            problem = difference(spark, con, entry.queries()[key], entry.oracle_sql()[key], folder)
        except Exception as error:  # report and go on with the other keys
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
