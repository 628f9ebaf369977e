"""Side-by-side check of every query against its SQL: python tests/check_queries.py [sf] [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else repr(v + 0.0)
        return "null" if v is None else str(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, run, sql, sf_dir):
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), "rows-only"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return len(got), "ok"
    if len(a) != len(b):
        return len(got), f"ROWS {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return len(got), f"VALUES {len(bad)} differ, first {bad[0]}"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from hazegrid.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    q, o = queries(), oracle_sql()
    failed = 0
    for name in argv[1:] or q:
        t = time.time()
        try:
            n, verdict = compare(spark, con, q[name], o.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            n, verdict = -1, "ERROR " + str(e).split("\n")[0][:400]
        failed += verdict not in ("ok", "rows-only")
        print(f"{name:28s} {n:7d} rows {time.time() - t:6.1f}s  {verdict}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
