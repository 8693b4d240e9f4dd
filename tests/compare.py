"""Run registered queries beside their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else f"{v:.6g}" if abs(v) >= 1e6 else f"{v + 0.0:.5f}"
    return f"{type(v).__name__}:{v}"


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    got = fn(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    if sql is None:
        return f"rows-only {len(rows)}"
    rel = con.sql(sql)
    names = list(rel.columns)
    if sorted(names) != sorted(got.columns):
        return f"FAIL columns {sorted(got.columns)} vs {sorted(names)}"
    exp = rel.fetchall()
    a, b = normal(got.columns, rows), normal(names, exp)
    if a == b:
        return f"ok {len(a)}" if a else "ok EMPTY"
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"FAIL rows {len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}"


def main(argv):
    import pathlib

    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from stratalens.session import local_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            res = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            res = f"ERROR {type(e).__name__}: {str(e)[:900]}"
        bad += res.startswith(("FAIL", "ERROR"))
        print(f"{name:38s} {time.time() - t0:6.1f}s {res}", flush=True)
    print("failing:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
