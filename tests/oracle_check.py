"""Runs registered queries against their SQL counterparts in DuckDB and compares the rows.

As a script: ``python tests/oracle_check.py <sf_dir> [query ...]``.
"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v == v else "NaN"
    return repr(v)


def normalise(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    mine = normalise(df.columns, df.collect())
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    theirs = normalise(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}: {mine[:2]} / {theirs[:2]}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first: {bad[0]}" if bad else None


def main(sf_dir: str, only: list[str]) -> None:
    from bench import session

    import __spark_entry__ as entry

    spark = session()
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    failed = []
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, fn, oracle[name], sf_dir)
                note = "same" if problem is None else problem
            else:
                note, problem = f"no SQL, {len(fn(spark, sf_dir).collect())} rows", None
        except Exception as e:  # noqa: BLE001
            problem = note = f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if problem is not None:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - start:6.2f}s {note[:700]}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
