"""Run registered queries next to their SQL and report differences: python -m checks.compare [folder] [name …]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from checks.queries import REGISTRY
from tidebook.session import spark_session


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(str(r[i]) for i in order) for r in rows])


def main(folder: str, wanted: list[str]) -> int:
    spark = spark_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="10g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    bad = 0
    for name, (query, sql) in REGISTRY.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if sql is None:
                print(f"{name:24} rows={len(got)} {took:.1f}s (no SQL)", flush=True)
                continue
            start = time.time()
            cur = con.execute(sql)
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            sql_took = time.time() - start
            if sorted(names) != sorted(df.columns):
                bad += 1
                print(f"{name:24} COLUMNS {sorted(set(names) ^ set(df.columns))}")
                continue
            a, b = canonical(got, df.columns), canonical(want, names)
            same = a == b
            print(f"{name:24} {'ok' if same else 'DIFF'} rows={len(a)}/{len(b)} {took:.1f}s sql={sql_took:.1f}s", flush=True)
            if not same:
                bad += 1
                shown = [(x, y) for x, y in zip(a, b) if x != y][:2]
                ordered = sorted(df.columns)
                for x, y in shown:
                    print("   ", [(c, u, v) for c, u, v in zip(ordered, x, y) if u != v][:6])
        except Exception as error:
            bad += 1
            print(f"{name:24} ERROR {str(error)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(main(where, sys.argv[2:]))
