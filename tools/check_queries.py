"""Run registered queries and compare them with their SQL in DuckDB.

    python tools/check_queries.py [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from siftline.plans.catalog import QUERIES, SQL, load  # noqa: E402
from siftline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def main(argv):
    sf = "sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    load()
    folder = f"/root/testdata/{sf}"
    spark = build_session(
        "check",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    bad = []
    for name in argv or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            if name not in SQL:
                print(f"rows  {name:28s} {len(got):8d} {spent:6.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(SQL[name])
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            duck = time.time() - start
            if sorted(names) != sorted(df.columns):
                bad.append(name)
                print(f"COLS  {name}: {sorted(df.columns)} vs {sorted(names)}", flush=True)
                continue
            a, b = rows_of(df.columns, got), rows_of(names, want)
            if a == b:
                print(f"ok    {name:28s} {len(a):8d} {spent:6.1f}s {duck:6.1f}s", flush=True)
                continue
            bad.append(name)
            only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
            print(f"DIFF  {name}: {len(a)} vs {len(b)} rows, {len(only_a)} / {len(only_b)} differ", flush=True)
            print("   spark:", *[x[:400] for x in only_a[:2]], sep="\n     ")
            print("   duck: ", *[x[:400] for x in only_b[:2]], sep="\n     ")
        except Exception as error:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {str(error)[:1200]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("bad:", bad)


main(sys.argv[1:])
