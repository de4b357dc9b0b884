"""Compare registered queries with DuckDB: ``python tests/oracle_check.py [sf] [name-part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float) and math.isnan(v):
        return (1, "nan")
    return (2, f"{v:.6f}" if isinstance(v, float) else str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([tuple(r[i] for i in order) for r in rows], key=lambda r: tuple(map(_key, r)))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1.5e-6 * max(1.0, abs(a)) or (math.isnan(a) and math.isnan(b))
    return a == b and type(a) is type(b)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{len(got)} rows (no SQL) {took:.1f}s"
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if not all(same(x, y) for x, y in zip(g, w))]
    exact = sum(g == w for g, w in zip(got, want))
    if bad:
        return False, f"{len(bad)}/{len(got)} rows differ, e.g. {got_cols}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}"
    return len(got) > 0, f"{len(got)} rows, {exact} bit-equal {took:.1f}s"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from bagframe.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    sf = sf if "/" in sf else f"/root/testdata/sf{sf}"
    parts = args[1:]
    spark, con = local_session(), connect(sf)
    sqls, failed = oracle_sql(), []
    for name, fn in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            ok, text = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001  (report and go on)
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
