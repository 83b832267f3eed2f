"""Run registered queries and compare them with their SQL in DuckDB.

python tests/check.py [name part ...]; CHECK_SF or CHECK_DIR picks the tables, CHECK_CHUNK the rows a group
may have before it is cut (small values force the code for oversized groups).
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """None when equal, else what differs."""
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    wanted_names, wanted = rows_of(relation.columns, relation.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, {len(wanted)} expected"
    def same(a, b):
        return all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-5)) for x, y in zip(a, b)
        )

    wrong = [(a, b) for a, b in zip(got, wanted) if not same(a, b)]
    kinds = [(type(x).__name__, type(y).__name__) for a, b in zip(got[:50], wanted[:50]) for x, y in zip(a, b) if x is not None and y is not None and type(x) is not type(y)]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ; {names}; first {wrong[0][0]} expected {wrong[0][1]}"
    if kinds:
        return f"types differ: {sorted(set(kinds))}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from voxlake.session import local_session

    folder = os.environ.get('CHECK_DIR') or f"/root/testdata/sf{os.environ.get('CHECK_SF', '0.01')}"
    conf = {"spark.voxlake.chunkRows": os.environ["CHECK_CHUNK"]} if "CHECK_CHUNK" in os.environ else {}
    spark = local_session(8, **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle, failed = entry.oracle_sql(), []
    chosen = [n for n in entry.queries() if not sys.argv[1:] or any(part in n for part in sys.argv[1:])]
    for name in chosen:
        begin = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in oracle:
                problem = compare(df, con, oracle[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        note = "" if name in oracle else " (rows only)"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name}{note} {time.time() - begin:.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} right; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
