"""Compare registered queries with their SQL: python tests/check_oracle.py [sf dir] [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
          " labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def compare(con, df, sql):
    """Empty text when both sides hold the same rows under the same column names."""
    got = sorted(tuple(plain(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; {got[:2]} {want[:2]}"
    off = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(off)} of {len(got)} rows differ, first {off[0]}" if off else ""


def main():
    from conftest import make_session
    from cohortry.queries import ORACLES, QUERIES
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            said = compare(con, df, ORACLES[name]) if name in ORACLES else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            said = f"FAILED {type(e).__name__} {str(e)[:1500]}"
        ok = not said or said.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {said}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
