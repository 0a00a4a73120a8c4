"""Run queries at one scale, compare with DuckDB and report times.

usage: python tests/check.py [sf_dir] [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tengen.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages " \
         "benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(None if v is None or v is pd.NA or v is pd.NaT or v != v else v for v in r)
            for r in pdf[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(a, b):
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, str) != isinstance(b, str):
        return False
    return a == b


def compare(spark_pdf, duck_pdf):
    ca, ra = canon(spark_pdf)
    cb, rb = canon(duck_pdf)
    if ca != cb:
        return f"columns {sorted(set(ca) ^ set(cb))}"
    if len(ra) != len(rb):
        return f"rows {len(ra)} != {len(rb)}"
    bad = [(x, y) for x, y in zip(ra, rb) if not all(map(same, x, y))]
    if bad:
        return f"{len(bad)} of {len(ra)} differ\n   {ca}\n   {bad[0][0]}\n   {bad[0][1]}"
    return ""


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", shuffle_partitions=8, spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
                          spark__sql__execution__arrow__pyspark__enabled="true")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or qs:
        try:
            t = time.time()
            pdf = qs[name](spark, sf).toPandas()
            ts = time.time() - t
            t = time.time()
            msg = "no oracle"
            if name in oracles:
                msg = compare(pdf, con.execute(oracles[name]).df()) or "ok"
            print(f"{name}: {len(pdf)} rows spark {ts:.2f}s duck {time.time() - t:.2f}s {msg}", flush=True)
            bad += msg not in ("ok", "no oracle")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:900]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
