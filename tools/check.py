"""Run the registered queries next to their SQL in DuckDB and compare all values.

    python tools/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
from pyspark.sql import SparkSession

from tidemark.catalog import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", default="")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.sf}/{t}.parquet')")
    bad = 0
    for name, (fn, sql) in catalog().items():
        if args.module and not fn.__module__.endswith(args.module):
            continue
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.sf)
            got = df.collect()
            took = time.time() - t0
            cols, mine = rows_of(df.columns, [tuple(r) for r in got])
            if sql is None:
                print(f"rows  {name}: {len(mine)} rows, {took:.2f}s")
                continue
            res = con.execute(sql)
            ocols, theirs = rows_of([d[0] for d in res.description], res.fetchall())
            types = dict(df.dtypes)
            otypes = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
            if cols != ocols:
                bad += 1
                print(f"FAIL  {name}: columns {cols} != {ocols}")
            elif mine != theirs:
                bad += 1
                diff = [(a, b) for a, b in zip(mine, theirs) if a != b][:3]
                print(f"FAIL  {name}: {len(mine)} vs {len(theirs)} rows {cols}")
                for a, b in diff:
                    print("   spark", a, "\n   duck ", b)
            else:
                note = " EMPTY" if not mine else ""
                odd = {c: (types[c], otypes[c]) for c in cols if not same_type(types[c], otypes[c])}
                print(f"ok    {name}: {len(mine)} rows, {took:.2f}s{note}{' types ' + str(odd) if odd else ''}")
        except Exception as e:
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}")
            if args.names:
                traceback.print_exc(limit=6)
    print("failures:", bad)
    return bad


SAME = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def same_type(spark_type: str, duck: str) -> bool:
    return SAME.get(spark_type) == duck


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
