"""Run catalogue queries and their SQL side by side and compare values exactly."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN"}


def difference(spark, con, sf_dir: str, name: str, df=None) -> str | None:
    """None when equal, else a short description."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir) if df is None else df
    rel = con.sql(oracle_sql()[name])
    want_types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    got_types = {c: _KINDS.get(t, t) for c, t in df.dtypes}
    if got_types != want_types:
        odd = {c: (got_types.get(c), want_types.get(c))
               for c in {*got_types, *want_types} if got_types.get(c) != want_types.get(c)}
        return f"columns differ: {odd}"
    cols = sorted(got_types)

    def order(row):
        return tuple((v is not None, str(v)) for v in row)

    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=order)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(got, want, strict=True):
        if g != w and not all(
                a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a)
                           and math.isnan(b)) for a, b in zip(g, w, strict=True)):
            return "values differ: " + str({c: (a, b) for c, a, b in zip(cols, g, w, strict=True)
                                            if a != b})
    if not got:
        return "no rows"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql
    from wirelens.session import local_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(oracle_sql())
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            out = difference(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            out = f"{type(e).__name__}: {str(e)[:600]}"
        bad += out is not None
        print(f"{name:28s} {time.time() - start:6.1f}s {out or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
