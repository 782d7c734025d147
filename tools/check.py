"""Compare the named queries with their SQL twins: names, types, row counts, values.

usage: python tools/check.py [pattern ...] [--sf DIR]
"""

import re
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from voxlake.plans.registry import all_queries, all_sql  # noqa: E402
from voxlake.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT", "date": "DATE"}


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = all_sql()
    bad = []
    for name, fn in all_queries().items():
        if args and not any(re.search(a, name) for a in args):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            types = [NAMES.get(dict(df.dtypes)[c], dict(df.dtypes)[c]) for c in cols]
            rows = Counter(tuple(r) for r in df.select(cols).collect())
            took = time.time() - start
            if name not in sql:
                print(f"rows {name}: {sum(rows.values())} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            res = con.execute(sql[name])
            desc = {d[0]: str(d[1]) for d in res.description}
            order = [d[0] for d in res.description]
            raw = res.fetchall()
            other = time.time() - start
            if sorted(order) != cols:
                bad.append(name)
                print(f"FAIL {name}: columns {cols} vs {sorted(order)}", flush=True)
                continue
            if [desc[c] for c in cols] != types:
                bad.append(name)
                print(f"TYPE {name}: " + ", ".join(f"{c}:{t}/{desc[c]}" for c, t in zip(cols, types) if t != desc[c]), flush=True)
            at = [order.index(c) for c in cols]
            want = Counter(tuple(r[i] for i in at) for r in raw)
            if rows == want and rows:
                print(f"ok   {name}: {sum(rows.values())} rows {took:.1f}s (sql {other:.1f}s)", flush=True)
            else:
                bad.append(name)
                print(f"FAIL {name}: {sum(rows.values())} vs {sum(want.values())} rows; columns {cols}", flush=True)
                print("   only spark:", sorted((rows - want), key=str)[:3], flush=True)
                print("   only sql:  ", sorted((want - rows), key=str)[:3], flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"ERR  {name}: {str(e)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
