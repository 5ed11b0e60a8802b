"""Holds queries against their SQL: python tests/compare.py SF_DIR [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    if x is None or x != x:
        return "\0"
    if isinstance(x, float):
        return f"{x:.9g}" if x != int(x) else str(int(x)) if abs(x) < 1e15 else f"{x:.9g}"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(plain(v) for v in x.values()) + "}"
    if hasattr(x, "isoformat"):
        return str(x)
    return str(x)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall())


def ours(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def main() -> int:
    import __spark_entry__ as e
    from stratagraph.runtime import session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    q, sql, bad = e.queries(), e.oracle_sql(), 0
    for name in only or q:
        t = time.time()
        try:
            a = ours(q[name](spark, sf_dir))
        except Exception as x:
            print(f"{name}: ERROR {str(x)[:1500]}")
            bad += 1
            continue
        took = time.time() - t
        if name not in sql:
            print(f"{name}: {len(a[1])} rows, {took:.1f} s, no SQL")
            continue
        t = time.time()
        try:
            b = oracle(sql[name], sf_dir)
        except Exception as x:
            print(f"{name}: SQL ERROR {str(x)[:800]}")
            bad += 1
            continue
        same = a == b
        bad += not same
        print(f"{name}: {'same' if same else 'DIFFERENT'} {len(a[1])} rows, {took:.1f} s, SQL {len(b[1])} rows {time.time() - t:.1f} s", flush=True)
        if not same:
            x, y = set(a[1]), set(b[1])
            print("  columns", a[0], b[0], "\n  only ours", sorted(x - y)[:4], "\n  only SQL", sorted(y - x)[:4])
    return bad


if __name__ == "__main__":
    sys.exit(main())
